"""Exact dedup by a cuckoo-filter index that holds live digests.

The index answers "seen before?" from 16-bit fingerprints in two candidate buckets. A fingerprint hit
is verified against what the bucket slot keeps of the content: the full SHA-256, the byte length and an
independent 64-bit hash of the text (the texts themselves would go through the shuffle). A live digest can be deleted again. When an insertion finds no
place after a run of displacements, the filter doubles and is filled again from its stored keys.

Two levels keep hot groups bounded. Each task indexes the rows it reads and passes on one row per
distinct digest; those are dealt out by digest, and each shard's index merges them. So a group of a
third of all rows sends one row per task, and no shard holds more than its share of distinct digests.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import join_sized, keep_only, trimmed
from strandline.session import materialize

_PARTIAL = "digest string, n_bytes long, alt long, keep_id long, size long"


class CuckooIndex:
    """Digest -> (largest id, rows). Digests are lower-case hex strings of at least 24 digits."""

    SLOTS = 4
    MAX_KICKS = 400

    def __init__(self, buckets: int = 1 << 10):
        self.resizes = 0
        self.digests: list[str | None] = []
        self.checks: list[tuple[int, int]] = []
        self.keep: list[int | None] = []
        self.size = array("q")
        self.live = 0
        self._free: list[int] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.fingers = array("H", bytes(2 * buckets * self.SLOTS))
        self.owners = array("q", bytes(8 * buckets * self.SLOTS))

    def _places(self, digest: str) -> tuple[int, int, int]:
        finger = int(digest[:4], 16) or 1
        first = int(digest[8:24], 16) & self.mask
        return finger, first, self._other(first, finger)

    def _other(self, bucket: int, finger: int) -> int:
        return bucket ^ (finger * 0x5BD1E995 & self.mask)

    def find(self, digest: str, check: tuple[int, int]) -> int:
        """The entry of a live digest, or -1. Fingerprint hits are verified against the stored content."""
        finger, one, two = self._places(digest)
        fingers, n = self.fingers, self.SLOTS
        for bucket in (one, two) if one != two else (one,):
            for slot in range(bucket * n, bucket * n + n):
                if fingers[slot] == finger:
                    entry = self.owners[slot]
                    if self.digests[entry] == digest and self.checks[entry] == check:
                        return entry
        return -1

    def add(self, digest: str, check: tuple[int, int], keep: int | None, size: int = 1) -> bool:
        """Merge rows into the digest's group; True if it is new."""
        entry = self.find(digest, check)
        if entry >= 0:
            old = self.keep[entry]
            self.keep[entry] = keep if old is None else old if keep is None else max(old, keep)
            self.size[entry] += size
            return False
        if self._free:
            entry = self._free.pop()
            self.digests[entry], self.checks[entry], self.keep[entry], self.size[entry] = digest, check, keep, size
        else:
            entry = len(self.digests)
            self.digests.append(digest)
            self.checks.append(check)
            self.keep.append(keep)
            self.size.append(size)
        self.live += 1
        if not self._place(entry):
            self._resize()
        return True

    def _place(self, entry: int) -> bool:
        finger, one, two = self._places(self.digests[entry])
        n = self.SLOTS
        for bucket in (one, two):
            for slot in range(bucket * n, bucket * n + n):
                if not self.fingers[slot]:
                    self.fingers[slot], self.owners[slot] = finger, entry
                    return True
        bucket = one
        for kick in range(self.MAX_KICKS):
            slot = bucket * n + (kick + finger) % n
            self.fingers[slot], finger = finger, self.fingers[slot]
            self.owners[slot], entry = entry, self.owners[slot]
            bucket = self._other(bucket, finger)
            for slot in range(bucket * n, bucket * n + n):
                if not self.fingers[slot]:
                    self.fingers[slot], self.owners[slot] = finger, entry
                    return True
        return False

    def _resize(self) -> None:
        """Double until every stored key has a place."""
        while True:
            self.resizes += 1
            self._clear(2 * (self.mask + 1))
            if all(self._place(e) for e, d in enumerate(self.digests) if d is not None):
                return

    def remove(self, digest: str, check: tuple[int, int]) -> bool:
        """Delete a live digest; its slot and its entry are free again."""
        entry = self.find(digest, check)
        if entry < 0:
            return False
        finger, one, two = self._places(digest)
        n = self.SLOTS
        for bucket in (one, two):
            for slot in range(bucket * n, bucket * n + n):
                if self.fingers[slot] == finger and self.owners[slot] == entry:
                    self.fingers[slot] = self.owners[slot] = 0
                    self.digests[entry] = None
                    self._free.append(entry)
                    self.live -= 1
                    return True
        return False

    def rows(self) -> Iterator[tuple[str, int, int, int | None, int]]:
        for entry, digest in enumerate(self.digests):
            if digest is not None:
                yield digest, *self.checks[entry], self.keep[entry], self.size[entry]


def _batches(rows: Iterator[tuple], schema: pa.Schema, n: int = 20_000) -> Iterator[pa.RecordBatch]:
    chunk: list[tuple] = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == n:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk, strict=True), schema, strict=True)], schema=schema)
            chunk = []
    if chunk:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk, strict=True), schema, strict=True)], schema=schema)


_ARROW = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("alt", pa.int64()), ("keep_id", pa.int64()), ("size", pa.int64())])


def _indexed(flush_at: int | None, least: int):
    """A task's index. flush_at: entries after which a partial result is passed on, so that memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, n_bytes, alt, keep, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index.add(digest, (n_bytes, alt), keep, size)
            if flush_at and index.live >= flush_at:
                yield from _batches(index.rows(), _ARROW)
                index = CuckooIndex()
        yield from _batches((r for r in index.rows() if r[4] >= least), _ARROW)

    return run


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest and the two values a hit is verified with; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("alt")
    )


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = 1_000_000, total: int | None = None) -> DataFrame:
    """digest, n_bytes, alt, keep_id, size of each text that two rows or more have.

    shard_keys bounds the digests of a shard (about 200 bytes each): more rows get more shards.
    """
    spark = docs.sparkSession
    total = docs.count() if total is None else total
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / shard_keys))
    partial = digests(docs, id_col, text_col).select("digest", "n_bytes", "alt", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size")).mapInArrow(trimmed(_indexed(shard_keys, 1)), _PARTIAL)
    return partial.repartition(shards, "digest").mapInArrow(trimmed(_indexed(None, 2)), _PARTIAL)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null and empty texts are equal. Null ids never
    win against others; a group of null ids only keeps its rows. Rows that repeat an id and its text
    are one document and share its verdict. Other columns of docs are not read.
    """
    total = docs.count()
    groups = materialize(copy_groups(docs, id_col, text_col, total=total).select("digest", "keep_id", "size"), "copies")
    joined = join_sized(digests(docs, id_col, text_col).select("doc_id", "digest"), groups, "digest", "size", total, "doc_id")
    keep_id = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce(F.col("size"), F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """docs without the rows that exact_dedup drops; all their columns. Rows with a null id stay.

    A verdict is that of an id and its text: another text under the same id has its own. Up to broadcast_rows
    dropped rows (20 MB at 40 bytes) are counted and broadcast; more are joined by a shuffle.
    """
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", F.unhex("text_sha256").alias("digest"))
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    return keep_only(docs, {"doc_id": docs[id_col].cast("long"), "digest": digest}, materialize(gone.distinct(), "dropped"), broadcast_rows)


def live_groups(changes: DataFrame, id_col: str = "doc_id", text_col: str = "text", op_col: str = "op", order_col: str = "seq") -> DataFrame:
    """Replay of 'insert' and 'delete' of texts in order_col's order: the digests that are live at the end.

    A delete takes the digest out with all its rows; deleting what is not live does nothing.
    """
    schema = "digest string, keep_id long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, n_bytes, alt, doc, op in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if op == "delete":
                    index.remove(digest, (n_bytes, alt))
                else:
                    index.add(digest, (n_bytes, alt), doc)
        rows = ((d, k, s) for d, _, _, k, s in index.rows())
        yield from _batches(rows, pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("size", pa.int64())]))

    shards = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = changes.select(
        F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("alt"), F.col(id_col).cast("long").alias("doc"), F.col(op_col).alias("op"), F.col(order_col).alias("__seq")
    )
    dealt = keyed.repartition(shards, "digest").sortWithinPartitions("__seq").select("digest", "n_bytes", "alt", "doc", "op")
    return dealt.mapInArrow(run, schema)
