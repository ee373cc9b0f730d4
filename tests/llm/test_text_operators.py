"""Operators over documents, held against brute force, exact round trips and held-out accuracy."""

import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import bytebpe, exact_dedup, language, near_dedup, packing, piece_bpe, quality_model, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = "doc_id long, text string, kept string, digest int"
ROWS = [
    (1, "the cat sat on the mat and looked at the dog for a while today", "x", 1),
    (2, "The cat sat on the mat and looked at the dog for a while today", "x", 1),
    (3, "the cat sat on the mat and looked at the dog for a while today", None, 1),
    (4, None, None, None),
    (5, "", "y", 2),
    (6, "one", "y", 2),
    (7, "one\n", "y", 2),
    (8, "a b", "y", 2),
    (9, " \t\n ", "y", 2),
    (10, "word " * 30_000, "y", 2),
    (10, "word " * 30_000, "y", 2),
    (11, "x" * 100_000, "y", 2),
    (12, "日本語 ▁ \U0001d4b3 <|endoftext|> é\x00", "y", 2),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, EDGE)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EDGE)


# exact dedup


def test_cuckoo_index_inserts_deletes_and_resizes():
    index = exact_dedup.CuckooIndex(2)
    keys = [sha256(str(i).encode()).hexdigest() for i in range(3000)]
    for i, key in enumerate(keys):
        assert index.add(key, (i, i), i)
    assert index.resizes > 3 and index.live == 3000
    assert not index.add(keys[7], (7, 7), 9000, 2)
    entry = index.find(keys[7], (7, 7))
    assert (index.keep[entry], index.size[entry]) == (9000, 3)
    assert index.find(keys[7], (8, 7)) == -1  # the fingerprint hits, the content doesn't
    for i in range(0, 3000, 2):
        assert index.remove(keys[i], (i, i))
    assert not index.remove(keys[0], (0, 0))
    assert {k for k, *_ in index.rows()} == set(keys[1::2])
    for i in range(0, 3000, 2):
        assert index.add(keys[i], (i, i), i)
    assert index.live == 3000 and all(index.find(k, (i, i)) >= 0 for i, k in enumerate(keys))


def _groups(rows):
    by = defaultdict(list)
    for doc_id, text in rows:
        by[text or ""].append(doc_id)
    return by


def test_exact_dedup_edges(edge):
    by = _groups((r[0], r[1]) for r in ROWS)
    got = exact_dedup.exact_dedup(edge).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""]), sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS)
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_null_ids_and_empty(spark, nothing):
    got = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got if r.group_size == 3) == [(0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True)]
    assert [(r.keep_id, r.kept) for r in got if r.group_size == 1] == [(None, True)]
    assert exact_dedup.exact_dedup(nothing).count() == 0


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_drop_copies_judges_an_id_with_each_of_its_texts(spark, broadcast_rows):
    def kept(*rows):
        return sorted(tuple(r) for r in exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=broadcast_rows).collect())

    assert kept((5, "A"), (9, "A"), (5, "B")) == [(5, "B"), (9, "A")]
    assert kept((5, "A"), (9, "A"), (9, "B"), (12, "B")) == [(9, "A"), (12, "B")]


def test_drop_copies_keeps_columns(edge):
    out = exact_dedup.drop_copies(edge)
    assert out.columns == edge.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 5, 6, 7, 8, 9, 10, 10, 11, 12]


def test_live_groups_replays_deletes(spark):
    rows = [(1, 1, "a", "insert"), (2, 2, "a", "insert"), (3, 3, "b", "insert"), (4, 0, "a", "delete"), (5, 4, "a", "insert"), (6, 0, "c", "delete"), (7, 0, "b", "delete")]
    got = exact_dedup.live_groups(spark.createDataFrame(rows, "seq int, doc_id long, text string, op string")).collect()
    assert [(r.digest, r.keep_id, r.size) for r in got] == [(sha256(b"a").hexdigest(), 4, 1)]


# near dedup


def brute_groups(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(docs, texts, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs, k, percent).collect()}
    assert got == brute_groups(texts.items(), k, percent)


def test_near_groups_edges(edge, nothing):
    got = near_dedup.near_groups(edge, 3, 85).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_groups([(r[0], r[1]) for r in ROWS], 3, 85)
    assert near_dedup.near_groups(nothing, 3, 85).count() == 0


def test_near_verdicts_are_of_rows(spark):
    text, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, text), (5, text), (5, other), (7, None), (None, other), (None, "alone here"), (8, ""), (9, other), (9, other)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, `__doc_id` int, `__text_hash` int")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(frame).collect())
    assert got == {(1, 1, True): 1, (5, 1, False): 1, (5, 5, True): 1, (7, 7, True): 1, (None, 5, False): 1, (None, None, True): 1, (8, 8, True): 1, (9, 5, False): 2}
    out = near_dedup.drop_near(frame)
    assert out.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == {(1, text): 1, (5, other): 1, (7, None): 1, (None, other): 1, (None, "alone here"): 1, (8, ""): 1}


def test_stars_lose_no_link(spark):
    """Mutants of one base: most are linked with the base alone, whose id isn't the smallest."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        own = list(base)
        for at in rng.choice(60, rng.integers(1, 4), replace=False):
            own[at] = f"m{i}_{at}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    want = brute_groups(rows, 3, 85)
    assert len({v[1] for v in want.values()}) > 1
    assert got == want


def test_components_of_long_paths(spark):
    rows = [(i, i + 1) for i in range(1, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {100 + i: 100 for i in range(1, 40)}


@pytest.mark.parametrize(("most", "chunk"), [(1 << 20, 1 << 20), (40, 8), (0, 16)])
def test_components_by_one_task_and_by_rounds(spark, most, chunk):
    """The three ways agree with a search: one task at the end, rounds until few are left, rounds to the end."""
    rng = np.random.default_rng(11)
    names = rng.permutation(1000).tolist()
    path = [(names[i], names[i + 1]) for i in range(120)]
    tree = [(names[i], names[200 + (i - 200) // 3]) for i in range(201, 400)]
    loose = [(names[400 + i], names[400 + j]) for i, j in rng.integers(0, 500, (260, 2)).tolist()]
    hub = [(names[950], names[i]) for i in range(900, 950)]
    rows = path + tree + loose + hub + path[:20]
    near = defaultdict(set)
    for a, b in rows:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for node in sorted(near):
        work = [node] if node not in want else []
        while work:
            want[x := work.pop()] = node
            work += [y for y in near[x] if y not in want]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = [(r.node, r.component) for r in near_dedup.components(edges, most=most, chunk=chunk).collect()]
    assert sorted(got) == sorted((x, c) for x, c in want.items() if x != c)
    assert near_dedup.components(edges.where("a = b"), most=most).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    """Each round is a dozen jobs whose plans and broadcasts the driver holds; few edges need none."""
    rows = [(i, i + 1) for i in range(1, 200)]
    sc = spark.sparkContext
    sc.setJobGroup("few edges", "components")
    try:
        assert near_dedup.components(spark.createDataFrame(rows, "a long, b long").repartition(8)).count() == 199
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("few edges")) <= 10


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for n in (8, 60, 2000):
        shared = rng.integers(0, 1 << 63, n, np.uint64)
        extra = rng.integers(0, 1 << 63, max(1, n // 5), np.uint64)
        rows = np.repeat([0, 1], [n, n + len(extra)])
        sig = near_dedup.signatures(rows, np.concatenate([shared, shared, extra]), 2, 1024)
        assert abs((sig[0] == sig[1]).mean() - n / (n + len(extra))) < 0.12


# quality rules


def test_rules_count_as_brute_force(edge, docs):
    for frame in (edge, docs):
        texts = {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}
        for r in quality_rules.quality_rules(frame).collect():
            text = texts[r.doc_id]
            w = WORD.findall(text)
            windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
            lines = [x for x in text.split("\n") if WORD.search(x)]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
            failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
            assert r.base_failed == failed and not (failed and r.kept)


def test_rules_on_nothing(nothing):
    assert quality_rules.quality_rules(nothing).count() == 0


def test_rules_have_no_user_functions(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rules_follow_labels(spark, sf, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in quality_rules.quality_rules(docs).collect():
        if not r.base_failed and r.doc_id in labels:
            assert r.kept == bool(labels[r.doc_id])


# language


def test_language_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(true) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(edge, nothing, docs):
    profiles = language.prototypes(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(edge, profiles).collect()}
    assert {i for i, v in got.items() if v == ("und", 0.0)} == {4, 5, 9}
    assert got[1][0] == "en"
    assert {r.lang_pred for r in language.predict(edge, {}).collect()} == {"und"}
    assert language.predict(nothing, profiles).count() == 0


def test_language_bound_is_a_share_of_hashed_ids(docs):
    few, all_ = language.prototypes(docs, max_rows=50), language.prototypes(docs)
    assert set(few) <= set(all_) and any(not np.allclose(few[k], all_[k]) for k in few)


def test_foreign_and_random_texts_are_dropped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = [
        "La mattina dopo il vecchio pescatore tornò alla spiaggia con le reti ancora bagnate e trovò che il mare aveva portato via la sua piccola barca.",
        "Następnego ranka stary rybak wrócił na plażę z mokrymi jeszcze sieciami i zobaczył, że morze zabrało jego małą łódź.",
        "Seuraavana aamuna vanha kalastaja palasi rannalle vielä märkien verkkojensa kanssa ja huomasi, että meri oli vienyt hänen pienen veneensä.",
        "Másnap reggel az öreg halász visszatért a partra a még nedves hálóival, és látta, hogy a tenger elvitte a kis csónakját.",
        "На следующее утро старый рыбак вернулся на берег с ещё мокрыми сетями и увидел, что море унесло его маленькую лодку.",
    ]
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    random = [" ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(100)) for _ in range(60)]
    planted = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(foreign + random)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in language.drop_unknown(docs.unionByName(planted)).select("doc_id").collect()}
    assert not [foreign[i - 10_000_000] for i in kept if 10_000_000 <= i < 10_000_000 + len(foreign)]
    assert sum(i >= 10_000_000 for i in kept) <= 2
    lettered = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert sum(i in kept for i in lettered) >= 0.995 * len(lettered)


def test_language_stage_judges_rows_not_ids(spark, docs):
    english = docs.where("lang = 'en' and n_chars > 400").first().text
    rows = [(1, english, None), (1, "12345 !!", None), (None, english, None), (None, "", None), (2, None, "en"), (3, "zzq xkw qqj vvx wkk " * 90, "xx")]
    frame = docs.select("doc_id", "text", "lang").withColumn("__found", F.lit(7)).withColumn("__own", F.lit("x"))
    planted = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, lang string, `__found` int, `__own` string").withColumn("doc_id", F.col("doc_id") + 10_000_000)
    out = language.drop_unknown(frame.unionByName(planted))
    assert out.columns == frame.columns
    kept = Counter((r.doc_id, r.text) for r in out.where("`__own` = 'y'").collect())
    assert kept == {(10_000_001, english): 1, (None, english): 1, (10_000_003, rows[-1][1]): 1}  # xx is learnt from its one row
    assert language.drop_unknown(planted.where("lang is null")).count() == 4  # no language is learnt
    assert language.drop_unknown(docs, share=2.0).count() < 0.1 * docs.count()


def test_one_varied_text_needs_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    text = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 100_000))
    space = language.Space()
    tracemalloc.start()
    got = space.bundles([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    codes, counts = space.grams(text)
    assert np.allclose(got, sum(space._bind(codes[i : i + 5000]).astype(np.float64).T @ counts[i : i + 5000] for i in range(0, len(codes), 5000)), rtol=1e-4, atol=0.5)


def test_bundles_and_cosines_equal_plain_loops(spark, docs, texts):
    """Letters' vectors rotated by place and multiplied, summed over all n-grams, normalised, by plain Python lists."""
    space = language.Space(128)

    def vector(letter):
        return space._letters(np.array([ord(letter) if letter != " " else 0]))[0].tolist()

    def plain(text):
        spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in spaced:
            spaced = spaced.replace("  ", " ")
        total = [0] * 128
        for i in range(len(spaced) - 2):
            bound = [1] * 128
            for place, letter in enumerate(reversed(spaced[i : i + 3])):
                v = vector(letter)
                bound = [x * v[(at - place) % 128] for at, x in enumerate(bound)]
            total = [x + y for x, y in zip(total, bound, strict=True)]
        return total

    def unit(v):
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v]

    few = docs.where("n_chars between 20 and 300 and lang is not null").orderBy("doc_id").limit(12)
    rows = few.collect()
    sums = {}
    for r in rows:
        one = unit(plain(r.text))
        assert np.allclose(space.bundles([r.text])[0], plain(r.text))
        sums[r.lang] = [x + y for x, y in zip(sums.get(r.lang, [0] * 128), one, strict=True)]
    profiles = {k: unit(v) for k, v in sorted(sums.items())}
    got = language.prototypes(few, dimension=128)
    assert list(got) == list(profiles) and all(np.allclose(got[k], profiles[k], atol=1e-5) for k in got)
    for r in language.predict(few, got).collect():
        cosine = {k: sum(a * b for a, b in zip(unit(plain(texts[r.doc_id])), v, strict=True)) for k, v in profiles.items()}
        best = max(cosine, key=cosine.get)
        assert r.lang_pred == best and abs(r.cosine - cosine[best]) < 1e-4
        assert abs(r.score - 1 / sum(np.exp(20 * (c - cosine[best])) for c in cosine.values())) < 1e-3


def test_identify_edges(edge, nothing):
    frame = edge.withColumn("lang", F.when(F.col("doc_id") < 4, F.lit("en")))
    got = language.identify(frame).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (4, 5, 9)} == {"und"}
    assert language.identify(nothing.withColumn("lang", F.lit("en"))).count() == 0


def test_letter_vectors_bind_by_place():
    space = language.Space(256)
    a, b = space.bundles(["abc", "acb"])
    assert np.array_equal(space.bundles(["ABC!"])[0], a) and abs(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) < 0.5


# packing


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_packing_covers_every_id_once(request, which):
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(which)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(frame, path).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for r in frame.select("doc_id", "text").dropDuplicates(["doc_id"]).collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        times = sum(x.length for x in pieces[r.doc_id]) // len(ids)
        assert times == (2 if which == "edge" and r.doc_id == 10 else 1)
        assert Counter(x for p in pieces[r.doc_id] for x in range(p.start, p.start + p.length)) == Counter({x: times for x in range(len(ids))})
        for p in pieces[r.doc_id]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == crc32(ids[p.start : p.start + p.length].tobytes())
    for own in windows.values():
        own.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in own])
        assert [p.offset for p in own] == [0, *ends[:-1]] and ends[-1] == own[0].tier <= 1024 and int(ends[-1]) & int(ends[-1] - 1) == 0


def test_step_groups_are_full_over_all_tasks(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, windows = defaultdict(Counter), defaultdict(set)
    rows = packing.pack(docs.repartition(5, "doc_id"), path, step_tokens=4096).collect()
    assert len({r.sequence_id >> 32 for r in rows}) == 5
    for r in rows:
        tokens[r.tier][r.step_group] += r.length
        windows[r.tier].add((r.tier_place, r.sequence_id))
    for tier, groups in tokens.items():
        assert all(n == max(4096, tier) for g, n in groups.items() if g != max(groups)) and groups[max(groups)] <= max(4096, tier)
        assert sorted(place for place, _ in windows[tier]) == list(range(len(windows[tier])))
    assert sum(len(g) for g in tokens.values()) <= sum(map(sum, (g.values() for g in tokens.values()))) // 4096 + len(tokens)
    assert packing.pack(nothing, path).count() == 0


def test_windows_equal_a_plain_packer():
    """Routing to tiers, longest-fit filling and closing cuts, replayed with a plain list that is searched whole."""
    rng = np.random.default_rng(8)
    sizes = [int(x) for x in np.minimum(rng.geometric(1 / 180, 300), 3000)]
    packer = packing.Packer(3, (256, 128, 64), pool=10**6)
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype=np.uint32))
    got = defaultdict(list)
    for r in packer.finish().to_pylist():
        got[r["sequence_id"]].append((r["doc_id"], r["start"], r["length"]))
    want, waiting, arrivals = [], [], 0
    for i, n in enumerate(sizes):
        for start in range(0, n - n % 256, 256):
            want.append([(i, start, 256)])
        if n % 256:
            arrivals += 1
            waiting.append((n % 256, arrivals, i, n - n % 256))
    while waiting:
        first = max(waiting)
        waiting.remove(first)
        size = min(t for t in (64, 128, 256) if t >= first[0])
        own, gap = [first[2:] + first[:1]], size - first[0]
        while gap and waiting:
            fit = [f for f in waiting if f[0] <= gap]
            f = max(fit) if fit else min(waiting)
            waiting.remove(f)
            if not fit:
                arrivals += 1
                waiting.append((f[0] - gap, arrivals, f[2], f[3] + gap))
            own.append((f[2], f[3], min(f[0], gap)))
            gap -= own[-1][2]
        want.append(own)
    plain = [sorted(w) for w in want[:-1]]
    assert [sorted(w) for w in list(got.values())[: len(plain)]] == plain
    assert all(sum(x[2] for x in w) & (sum(x[2] for x in w) - 1) == 0 for w in got.values())
    assert sum(x[2] for w in got.values() for x in w) == sum(sizes)


def test_byte_bpe_equals_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, tok = bytebpe.ByteBpe(path), Tokenizer.from_file(path)
    for text in ("", "it's  a\n\n test 123", "éß漢字\U0001f600\x00", "a<|endoftext|>b", "x" * 5000, " \t  y"):
        assert own.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


# pieces


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_sentencepiece_without_dropout(model, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [t or "" for t in texts.values()] + ["", "  two  blanks ", "日本語\x00\t𝒳", "x" * 300, "!" * 97 + " " * 200]
    got = piece_bpe.encode_many(model, own, piece_bpe._keys(list(range(len(own))), 1), 0.0)
    assert [x.tolist() for x in got] == sp.encode(own)


def test_dropout_is_seeded_varied_and_lossless(model, texts):
    own = [t or "" for t in texts.values()][:40] + ["▁ literal ▁▁", "a▁" * 90, "日本語\x00\t𝒳 " * 40]
    one, again, other = (piece_bpe.encode_many(model, own, piece_bpe._keys(list(range(len(own))), seed), 0.2) for seed in (1, 1, 2))
    assert all(np.array_equal(a, b) for a, b in zip(one, again, strict=True))
    assert sum(not np.array_equal(a, b) for a, b in zip(one, other, strict=True)) > 30
    assert all(model.decode(x.tolist()) == t for x, t in zip(one, own, strict=True))


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0])
def test_arrays_take_the_agendas_merges(model, rate):
    own = ["the quick brown  fox, überholt naïvely 12345 !!", "tionthering andof"]
    keys = piece_bpe._keys([5, 6], 3)
    got = piece_bpe.encode_many(model, own, keys, rate)
    for text, key, ids in zip(own, keys, got, strict=True):
        want = []
        for m in re.finditer(" *[^ ]+| +$", " " + text):
            chunk_key = piece_bpe.mix(np.array([key]) + np.array([m.start()], np.uint64) * piece_bpe._B)[0]
            points = [piece_bpe.BLANK if c == " " else ord(c) for c in m.group()]
            want += [s for _, s in piece_bpe.agenda(model, points, int(chunk_key), rate)]
        assert model.expand(np.array(want)).tolist() == ids.tolist()


def plain_dropout(model, text, doc_id, seed, rate):
    """Ids of a text from the model file alone: the whole chunk is searched for its best candidate before every merge."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        spec.ParseFromString(f.read())
    ids = {p.piece: i for i, p in enumerate(spec.pieces)}
    score = {p.piece: p.score for p in spec.pieces if p.type == p.NORMAL}
    full = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    a, b, c = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    text_key = mix((doc_id * a + mix(seed + 1)) & full)
    out = []
    for m in re.finditer(" *[^ ]+| +$", " " + text) if text else ():
        key = mix((text_key + m.start() * b) & full)
        parts = [x.replace(" ", "▁") for x in m.group()]
        starts = list(range(len(parts)))
        literal = {i for i, x in enumerate(m.group()) if x == "▁"}  # these are no blanks and merge with nothing
        while True:
            found = []
            for i in range(len(parts) - 1):
                joined = parts[i] + parts[i + 1]
                if joined in score and parts[i] in score and parts[i + 1] in score and not literal & {starts[i], starts[i + 1]}:
                    if rate == 0 or mix((key + starts[i] * a + starts[i + 1] * b + ids[joined] * c) & full) >= rate * 2.0**64:
                        found.append((-score[joined], ids[joined], i))
            if not found:
                break
            _, _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del starts[i + 1]
        for at, x in zip(starts, parts, strict=True):
            out += [ids[x]] if x in score and at not in literal else [ids[f"<0x{v:02X}>"] for v in x.encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_dropout_equals_a_plain_search(model, texts, rate):
    own = [t for t in texts.values() if t and len(t) < 400][:25] + ["x" * 40 + "tionthering" * 12, "überholt " * 9 + "日本語のテキスト" * 20, "a ▁b  c ▁▁", "", "  "]
    got = piece_bpe.encode_many(model, own, piece_bpe._keys(list(range(len(own))), 17), rate)
    assert [x.tolist() for x in got] == [plain_dropout(model, t, i, 17, rate) for i, t in enumerate(own)]


def test_encode_and_decode_frames(edge, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_bpe.encode(edge, path)
    assert all(r.lossless for r in encoded.collect())
    back = Counter((r.doc_id, r.text) for r in piece_bpe.decode(encoded, path).collect())
    assert back == Counter((r[0], r[1] or "") for r in ROWS)
    assert piece_bpe.encode(nothing, path, digests=True).count() == 0


# quality model


def test_quality_is_right_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    true = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_model.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in true]
    assert sum(r.predicted == true[r.doc_id] for r in held) >= 0.97 * len(held)


def test_quality_edges(spark, sf, edge, nothing):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert quality_model.quality_scores(edge, labels).count() == len(ROWS)
    assert quality_model.quality_scores(nothing, labels).count() == 0
    none = labels.where("false")
    assert quality_model.drop_poor(edge, none).count() == len(ROWS)
    assert {r.score for r in quality_model.quality_scores(edge, none).collect()} == {0.5}


def plain_statistics(text):
    """The features of a text by regular expressions and counters."""
    from math import log, log1p

    def odds(part, whole):
        return log((part + 0.5) / (max(whole - part, 0) + 0.5))

    raw = (text or "").encode()
    w = [m.encode() for m in WORD.findall(text or "")]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else Counter([tuple(w)] if w else [])
    lines = Counter(x for x in raw.split(b"\n") if x)
    counts = [sum(b in kind for b in raw) for kind in (b"#*$%&<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"|", b"0123456789")]
    return [
        log1p(len(w)), log1p(sum(map(len, w)) / max(len(w), 1)), *(odds(c, len(raw)) for c in counts), odds(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w)),
        odds(sum(windows.values()) - len(windows), sum(windows.values())), odds(sum(lines.values()) - len(lines), sum(lines.values())), log1p(len(set(w))) - 0.8 * log1p(len(w)),
    ]


def test_statistics_equal_plain_counts(docs):
    own = [r.text for r in docs.limit(60).collect()] + [r[1] for r in ROWS if r[0] < 10] + ["a a a b\n\nA | B | C!!\nA | B | C!!", "  é #1 \x00"]
    got = quality_model._columns(pa.array(own, pa.string()))
    assert np.allclose(got, [plain_statistics(t) for t in own], atol=1e-9)


def test_scores_equal_plain_densities(spark, docs):
    """Moments, shrinkage, log-densities and the posterior from the texts, with an inverse and a determinant in place of Cholesky factors."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    mark = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.collect()
    x = {r.doc_id: np.array(plain_statistics(r.text)) for r in rows}
    by = [np.array([x[i] for i, q in mark.items() if q == k and i in x and crc32(str(i).encode()) % 4 != 2]) for k in (0, 1)]
    n = [len(b) for b in by]
    covs = [np.cov(b.T, bias=True) for b in by]
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / sum(n)
    log = {}
    for k in (0, 1):
        c = 0.85 * covs[k] + 0.15 * pooled
        c = 0.85 * c + 0.15 * np.diag(np.diag(c)) + 0.2 * np.eye(len(c))
        for i, v in x.items():
            d = v - by[k].mean(0)
            log[i, k] = np.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.inv(c) @ d
    got = {r.doc_id: r.score for r in quality_model.quality_scores(docs, labels).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(np.clip(log[i, 0] - log[i, 1], -700, 700)))) < 1e-6 for i in x)


def test_conflicting_labels_and_row_verdicts(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    upset = labels.union(labels.withColumn("quality", F.lit(1))).union(labels.limit(3).withColumn("quality", F.lit(None).cast("int")))
    one, two = ({r.doc_id: r.score for r in quality_model.quality_scores(docs, x).collect()} for x in (labels, upset))
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)  # of conflicting labels the smallest counts
    rows = quality_model.quality_scores(docs, labels).where("predicted = 1").limit(1).collect()
    good = docs.where(F.col("doc_id") == rows[0].doc_id).first().text
    bad = "!!! ### buy !!! " * 60
    rows = [(90_000_001, good, 1), (90_000_001, bad, 1), (None, good, 1), (None, bad, 1), (None, None, 1), (90_000_002, "", 1)]
    both = spark.createDataFrame(rows, "doc_id long, text string, `__id` int").unionByName(docs.select("doc_id", "text", F.lit(0).alias("__id")))
    scores = sorted((r.doc_id or 0, r.score) for r in quality_model.quality_scores(both, labels).where("doc_id is null or doc_id > 90000000").collect())
    assert len(scores) == 6 and scores[-1][1] in {s for i, s in scores if i == 0}  # null is empty
    kept = Counter((r.doc_id, r.text) for r in quality_model.drop_poor(both, labels).where("`__id` = 1 and text <> ''").collect())
    assert kept == {(90_000_001, good): 1, (None, good): 1}
    assert np.array_equal(*quality_model._columns(pa.array([None, ""], pa.string())))


def test_discriminant_separates_gaussians():
    rng = np.random.default_rng(1)
    x = [rng.normal(m, s, (400, 3)) for m, s in ((0, 1), (2, 0.5))]
    model = quality_model.Discriminant(np.array([400.0, 400.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    assert (model.score(x[0]) < 0.5).mean() > 0.95 and (model.score(x[1]) > 0.5).mean() > 0.95


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_stars_of_cut_keys_reach_every_member(spark, most, monkeypatch):
    """A key with half of all rows is spread over tasks; its stars and their centres' star still span it, and emit no more edges than rows."""
    own = near_dedup._runs
    monkeypatch.setattr(near_dedup, "_runs", lambda turn: own(turn, most))
    rng = np.random.default_rng(6)
    keys = [7] * 1000 + rng.integers(0, 300, 1000).tolist()
    rows = [(k, i, 10, i) for i, k in enumerate(keys)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        starred = near_dedup._starred(spark.createDataFrame(rows, near_dedup._MEMBER)).cache()
        edges = [(r.a, r.b) for r in near_dedup._edges(starred, 80).collect()]
        again = near_dedup._starred(spark.createDataFrame([(k, r, n, 1) for k, r, n, _ in rows], near_dedup._MEMBER)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    members = defaultdict(list)
    for k, i, *_ in rows:
        members[k].append(i)
    assert len(edges) <= len(rows)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for own_rows in members.values():
        seen, work = {own_rows[0]}, [own_rows[0]]
        while work:
            work += (new := near[work.pop()] - seen)
            seen |= new
        assert set(own_rows) <= seen
    assert all(r.border and r.row == r.centre for r in again)  # one label: only centres of keys that may be cut
