"""Hierarchical multi-length packing of token streams.

Every document's ids are cut into whole windows of the longest context; what is left of it is routed
to the context tier it fits: the smallest one that holds it. Windows are opened from the longest tier
down. The gap of a window is filled with the longest whole fragments that fit, which come from
shorter tiers, and closed by cutting one more; the cut's rest goes back to its own tier. So a window
holds exactly its tier's length. At the end of a partition the last window has nothing left to fill it
and and is cut into windows of smaller powers of two.

Each task packs the rows it reads, with a bounded pool of fragments: no text or id is shuffled, no
sequence spans two tasks, and a task that is run again gives the same sequences. Step groups of equal
tokens are dealt out over all tasks: a window's place in its tier is its place in its task and the
windows of that tier in the tasks before, so every group but a tier's last is full.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.bytebpe import ByteBpe
from strandline.llm.common import trimmed
from strandline.session import materialize

END = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, nth long"
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int32() if c.endswith(" int") else pa.int64() for c in SCHEMA.split(", ")]


class Packer:
    """Packs (doc_id, ids) into windows. tiers: powers of two, the longest is the context."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = (1024, 512, 256, 128), pool: int = 2048):
        self.tiers, self.context, self.pool = sorted(tiers), max(tiers), pool
        self.task, self.base, self.windows = partition, partition << 32, 0
        self.per_tier: dict[int, int] = {}
        self.waiting: list[tuple] = []  # (length, arrival, doc_id, start, ids, doc_tokens), shortest first
        self.arrivals = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.context:
            self._window([(self.context, 0, doc_id, start, ids[start : start + self.context], n)], self.context)
            start += self.context
        if start < n:
            self._wait(doc_id, start, ids[start:], n)
        if len(self.waiting) >= self.pool:
            self._pack(self.pool // 2)

    def _wait(self, doc_id, start, ids, doc_tokens) -> None:
        self.arrivals += 1
        insort(self.waiting, (len(ids), self.arrivals, doc_id, start, ids, doc_tokens), key=lambda f: f[:2])

    def _pack(self, keep: int) -> None:
        """Open windows with the longest waiting fragments until keep fragments are left."""
        while len(self.waiting) > keep:
            first = self.waiting.pop()
            size = next(t for t in self.tiers if t >= first[0])
            pieces, gap = [first], size - first[0]
            while gap and self.waiting:
                at = bisect_right(self.waiting, gap, key=lambda f: f[0])
                if at:
                    piece = self.waiting.pop(at - 1)
                else:
                    length, arrival, doc_id, start, ids, n = self.waiting.pop(0)
                    piece = (gap, arrival, doc_id, start, ids[:gap], n)
                    self._wait(doc_id, start + gap, ids[gap:], n)
                pieces.append(piece)
                gap -= piece[0]
            if gap:
                self._split(pieces, size - gap)
            else:
                self._window(pieces, size)

    def _split(self, pieces: list[tuple], total: int) -> None:
        """Windows of the powers of two that total is made of, longest first."""
        for bit in reversed(range(total.bit_length())):
            size = 1 << bit
            if not total & size:
                continue
            own, room = [], size
            while room:
                length, arrival, doc_id, start, ids, n = pieces.pop(0)
                take = min(length, room)
                own.append((take, arrival, doc_id, start, ids[:take], n))
                if take < length:
                    pieces.insert(0, (length - take, arrival, doc_id, start + take, ids[take:], n))
                room -= take
            self._window(own, size)

    def _window(self, pieces: list[tuple], size: int) -> None:
        nth = self.per_tier[size] = self.per_tier.get(size, -1) + 1
        offset = 0
        for length, _, doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, length, crc32(ids.astype("<u4").tobytes()), n, self.base + self.windows, offset, size, self.task, nth))
            offset += length
        self.windows += 1

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else ([] for _ in _FIELDS)
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names=_FIELDS)
        self.rows = []
        return batch

    def finish(self) -> pa.RecordBatch:
        self._pack(0)
        return self.take()


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = (1024, 512, 256, 128), step_tokens: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: its place in the document and in a sequence, tier and step group.

    A document is its ids under the tokenizer file, then id 0; a null or empty text is id 0 alone. Each
    id lies in exactly one piece. Rows that repeat an id are packed each. A step group holds step_tokens
    in windows of one tier, or one window of a longer tier. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), tiers)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                for doc_id, text in zip(own.column(0).to_pylist(), own.column(1), strict=True):
                    packer.add(doc_id, np.append(bpe.encode(text.as_py()), np.uint32(END)))
                yield packer.take()
        yield packer.finish()

    pieces = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), SCHEMA), "pieces")
    return _grouped(pieces, step_tokens)


def _grouped(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """pieces with step_group for task and nth. The table of windows before each task has a row a task and tier."""
    windows = pieces.where("offset = 0").groupBy("task", "tier").agg(F.count(F.lit(1)).alias("windows"))
    earlier = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = windows.select("task", "tier", F.coalesce(F.sum("windows").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("nth")
    group = F.shiftleft(F.col("tier").cast("long"), 40) + F.expr("(before + nth) div greatest(1, {} div tier)".format(step_tokens))
    return pieces.join(before, ["task", "tier"]).select(*[F.col(c) for c in _FIELDS[:8]], place.alias("tier_place"), group.alias("step_group"))
