"""Every registered query against its SQL on the smallest tables; those without SQL against plain Python."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__
from strandline.functions import digest
from strandline.operators import lookup, rd, stats
from strandline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_document_digests_equal_plain_folds(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in registry.QUERIES["document_digests"](spark, sf).collect():
        raw = texts[r.doc_id]
        assert (r.crc8, r.crc16, r.ogg) == tuple(digest.crc_of(k, raw) for k in digest.CRCS)
        assert (r.fnv32, r.fnv64) == (digest.fnv_of(raw, *digest.FNV32, 32), f"{digest.fnv_of(raw, *digest.FNV64, 64):016x}")


def test_known_digests():
    assert digest.crc_of("crc8", b"123456789") == 0xF4 and digest.crc_of("crc16", b"123456789") == 0xFEE8
    assert digest.fnv_of(b"a", *digest.FNV64, 64) == 0x7688568A8EB3B7A2 and digest.fnv_of(b"foobar", *digest.FNV32, 32) == 3214735720


def test_huffman_lengths_are_optimal_and_legal():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 200):
        counts = rng.integers(1, 1000, n).tolist()
        lengths = stats.code_lengths(counts)
        if n > 1:
            assert abs(sum(2.0**-x for x in lengths) - 1) < 1e-9
            order = sorted(range(n), key=lambda i: counts[i])
            assert all(lengths[a] >= lengths[b] for a, b in zip(order, order[1:], strict=False) if counts[a] < counts[b])
    assert max(stats.code_lengths([2.0**i for i in range(40)])) <= 16
    assert stats.code_lengths([1, 1, 1]) == [2, 2, 1] or sorted(stats.code_lengths([1, 1, 1])) == [1, 2, 2]


def test_best_path_equals_enumeration():
    rng = np.random.default_rng(3)
    from itertools import product

    for _ in range(20):
        costs, moves, start = rng.integers(0, 9, (5, 3)).astype(float), rng.integers(0, 5, (3, 3)).astype(float), rng.integers(0, 3, 3).astype(float)
        best = min(start[p[0]] + sum(costs[b, c] for b, c in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False)) for p in product(range(3), repeat=5))
        path, total = rd.best_path(costs, moves, start)
        assert total == best == start[path[0]] + sum(costs[b, c] for b, c in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))


def test_allocation_equals_plain_bisection(spark):
    rng = np.random.default_rng(4)
    rows = [(f, g, float(400 - 15 * g + rng.integers(0, 9)), float((g + 1) ** 2 * rng.uniform(0.5, 2)), 100) for f in range(30) for g in range(20)]
    curve = spark.createDataFrame(rows, "f int, g int, r double, d double, c int")
    target = 30 * 230.0

    def choose(lam):
        return {f: min(((d + lam * r, g, r) for f2, g, r, d, _ in rows if f2 == f))[1:] for f in range(30)}

    lo, hi = rd.LOW, rd.HIGH
    for _ in range(rd.STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(r for _, r in choose(math.exp(mid)).values()) > target - rd.SIDE_BITS * 30 else (lo, mid)
    lam, picks = rd.allocate(curve, "f", target)
    assert abs(math.log(lam) - hi) < 1e-6
    assert {r.f: (r.g, r.r) for r in picks.collect()} == choose(math.exp(hi))
    with pytest.raises(ValueError, match="no candidate"):
        rd.allocate(curve, "f", target, cap=1)


def test_asof_ties_and_misses(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 3), (None, 4)], "g string, k int")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 7, 3), ("b", 4, 4)], "g string, k int, v int")
    assert {(r.g, r.k): r.v for r in lookup.asof(left, right, ["g"], "k", ["v"]).collect()} == {("a", 1): None, ("a", 5): 2, ("a", 9): 3, ("b", 3): None, (None, 4): None}
    wide = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    marks = spark.createDataFrame([(-50, 1), (13, 2), (612, 3)], "k long, v int")
    got = {r.k: r.v for r in lookup.asof_all(wide, marks, "k", ["v"]).collect()}
    assert got == {k: 1 if k < 13 else 2 if k < 612 else 3 for k in range(0, 1000, 7)}


def test_sums_and_places_run_over_ranges(spark):
    rng = np.random.default_rng(7)
    keys = rng.permutation(3000)[:1000].tolist()
    rows = spark.createDataFrame([(int(k), int(v)) for k, v in zip(keys, rng.integers(0, 9, 1000), strict=True)], "k long, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.k: (r.s, r.n) for r in lookup.numbered(lookup.running_sum(rows, "k", lookup.F.col("v"), "s"), "k").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total, want = 0, {}
    for i, r in enumerate(sorted(rows.collect())):
        want[r.k] = (total, i)
        total += r.v
    assert got == want
    assert lookup.numbered(rows.where("false"), "k").count() == 0


def test_a_hot_group_is_cut_over_ranges(spark):
    """Three quarters of the rows in one group: places, and the last mark before each, over several ranges and for null groups."""
    rng = np.random.default_rng(8)
    rows = [(None if g == 9 else 0 if g > 1 else int(g), int(k)) for g, k in zip(rng.integers(0, 10, 900), rng.permutation(5000)[:900], strict=True)]
    marks = [(0, int(k), int(k) % 7) for k in rng.integers(0, 5000, 40)] + [(None, 700, 3), (1, 2000, 5)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left, right = spark.createDataFrame(rows, "g int, k long"), spark.createDataFrame(marks, "g int, k long, v int")
        got = {(r.g, r.k): (r.n, r.v) for r in lookup.asof(lookup.placed(left, ["g"], "k"), right, ["g"], "k", ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for g, k in rows:
        last = max(((mk, v) for mg, mk, v in marks if mg == g and mk <= k), default=(0, None))
        assert got[g, k] == (sum(g2 == g and k2 < k for g2, k2 in rows), last[1])


def test_palette_images_hold_every_sample(spark, sf):
    sizes = [r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect()]
    assert registry.QUERIES["palette_images"](spark, sf).count() == sum(-(-n // 64) * 64 for n in sizes)


def test_alignment_signal_compares_past_the_first_samples(spark, tmp_path):
    values = [500.0 * (i * i % 13 if i >= 30 else 0) for i in range(60)]  # only past a prefix do shifts differ
    rows = [(i, 1, v) for i, v in enumerate(values)] + [(1000 + i, 2, 500.0 * i) for i in range(4)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    x = [int(v * 100) // 500 for v in values]
    best = min((sum(a != b for a, b in zip(x[3:43], x[k : k + 40], strict=True)), abs(k - 4), k) for k in range(21))
    got = {r.user_id: (r.mismatches, abs(r.shift - 4), r.shift) for r in registry.QUERIES["alignment_signal"](spark, str(tmp_path)).collect()}
    assert got[1] == best == (0, 1, 3) and set(got) == {1, 2}


def test_symbol_stream_rounds_in_the_vectors_own_precision(spark, tmp_path):
    """-0.16249999403953552 times 40 is 6.5 in 32 bits and less in 64; the tie goes away from zero."""
    vectors = [[-0.16249999403953552] + [0.0] * 63, [0.0125] * 64, [0.4999999 / 40] * 64]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[3] for r in c.execute(registry.ORACLES["symbol_stream"]).fetchall()}
    assert want[0] == 7 and {r.vec_id: r.magnitude for r in registry.QUERIES["symbol_stream"](spark, str(tmp_path)).collect()} == want


@pytest.fixture(scope="module")
def loud(spark, tmp_path_factory):
    """Events whose half signals leave 16 bits: first, last and inside a block, alone in it, and all of a block alike."""
    at = str(tmp_path_factory.mktemp("loud"))
    values = {1: [0.02 * i for i in range(70)], 2: [772.66] + [3.0 * i for i in range(40)] + [743.21], 3: [5.0] * 33 + [900.5, 655.34, 655.36], 4: [1310.74] * 40, 5: [83000.01, 1.0] * 20, 6: [700.0]}
    rows = [(1000 * u + i, u, v) for u, x in values.items() for i, v in enumerate(x)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{at}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{at}/events.parquet/*.parquet'")
    return at, c


def _same(spark, loud, name):
    at, c = loud
    found = c.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[k]) for k in columns) for r in registry.QUERIES[name](spark, at).collect()), key=repr) == want


def test_wav_samples_beyond_16_bits_are_kept(spark, loud):
    _same(spark, loud, "wav_samples")


@pytest.mark.parametrize("name", ["pcm_pins", "flac_samples"])
def test_streams_beyond_16_bits_are_read_back_whole(spark, loud, name):
    _same(spark, loud, name)
