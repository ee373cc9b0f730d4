"""Each stage on its own input against what it must keep."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows before and after every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_are_in_order_and_keep_columns(stages):
    assert list(stages) == ["documents", "quality", "language", "exact_dedup", "near_dedup", "packing"]
    for name in list(stages)[1:-1]:
        assert stages[name].columns == COLUMNS


def test_quality_and_language_follow_labels(spark, sf, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = set(ids(stages["quality"]))
    marked = [i for i in ids(stages["documents"]) if i in labels]
    assert sum((i in kept) == bool(labels[i]) for i in marked) >= 0.97 * len(marked)
    assert all(i in kept for i in marked if labels[i])
    before, after = ids(stages["quality"]), ids(stages["language"])
    assert set(after) <= set(before) and len(after) >= 0.99 * len(before)


def test_exact_and_near_copies_keep_one(stages):
    by = defaultdict(list)
    for r in stages["language"].collect():
        by[r.text or ""].append(r.doc_id)
    assert ids(stages["exact_dedup"]) == sorted(max(v) for v in by.values())
    rows = [(r.doc_id, r.text) for r in stages["exact_dedup"].collect()]
    assert ids(stages["near_dedup"]) == sorted(i for i, (_, _, kept) in brute_groups(rows, 5, 80).items() if kept)


def test_packing_holds_every_kept_document(stages):
    pieces = defaultdict(int)
    size = {}
    for r in stages["packing"].collect():
        pieces[r.doc_id] += r.length
        size[r.doc_id] = r.doc_tokens
    assert dict(pieces) == size and sorted(pieces) == ids(stages["near_dedup"])


def test_stages_take_odd_rows(spark, sf):
    """Nulls, repeated ids with one text and with two, null ids, a very long text, columns of internal names: each row by its own text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = stages_good(docs)
    long = " ".join(good)
    odd = [(1, good[0]), (1, good[0]), (1, good[1]), (2, good[0]), (None, good[2]), (3, None), (4, ""), (5, "!!!! #### !!!!"), (6, long), (1, "!!!! #### !!!!")]
    extra = ("__dropped", "__wanted", "__found", "__own", "__doc_id", "__digest", "__text_hash", "row", "key")
    planted = spark.createDataFrame([(None if i is None else 90_000_000 + i, t) for i, t in odd], "doc_id long, text string")
    frame = docs.unionByName(planted, allowMissingColumns=True)
    for c in extra:
        frame = frame.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns == [*COLUMNS, *extra], name
        frame = frame.persist()
    kept = {(r.doc_id and r.doc_id - 90_000_000, r.text) for r in frame.where("doc_id is null or doc_id >= 90000000").collect()}
    texts = {(i, t) for i, t in kept}
    assert (None, good[2]) in texts and (6, long) in texts
    assert not {(3, None), (4, ""), (5, "!!!! #### !!!!"), (1, "!!!! #### !!!!"), (1, good[0])} & texts
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
    assert pieces.select("doc_id").distinct().count() == frame.select("doc_id").distinct().count()


def stages_good(docs):
    """English texts that stand for themselves in the corpus."""
    rows = docs.where("lang = 'en' and n_chars between 800 and 4000").orderBy("doc_id").collect()
    kept = {r.text for r in rows if sum(x.text == r.text for x in rows) == 1}
    return [f"{r.text} and this end was put here {i} times for the test" for i, r in enumerate(r for r in rows if r.text in kept)]


def test_an_empty_corpus_passes_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = docs if "sequence_id" in out.columns else out
