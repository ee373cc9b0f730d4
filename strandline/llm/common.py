"""What the operators share: skew-safe joins on keys with known group sizes, safe names and learning splits."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key counts as heavy from 1 / HEAVY of the rows, so there are at most HEAVY heavy keys.
HEAVY = 2000


def join_sized(left: DataFrame, right: DataFrame, key: str, size: str, total: int, row_id: str, how: str = "left") -> DataFrame:
    """left JOIN right on a key; right has one row a key and, in size, the rows left has of it.

    Keys of more than total / HEAVY rows are at most HEAVY, as the sizes add up to total at most, and
    are broadcast. The rest are joined by a shuffle in which no key has a larger share than that: rows
    of heavy and of null keys go through it under a hash of row_id, marked so that they meet nothing there.
    """
    values = [c for c in right.columns if c != key]
    heavy = F.broadcast(right.where(F.col(size) * HEAVY > total).select(F.col(key), *[F.col(c).alias(f"__h_{c}") for c in values]))
    light = right.where(F.col(size) * HEAVY <= total).select(F.col(key).alias("__key"), F.lit(0).alias("__of"), *[F.col(c).alias(f"__l_{c}") for c in values])
    hot = F.col(f"__h_{size}").isNotNull()
    apart = hot | F.col(key).isNull()
    other = F.xxhash64(row_id).cast(left.schema[key].dataType)
    spread = left.join(heavy, key, "left").withColumn("__spread", F.when(apart, other).otherwise(F.col(key))).withColumn("__hot", apart.cast("int"))
    joined = spread.join(light, (F.col("__spread") == F.col("__key")) & (F.col("__hot") == F.col("__of")), "left")
    out = joined.select(*[F.col(c) for c in left.columns], *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__l_{c}")).alias(c) for c in values])
    return out.where(F.col(size).isNotNull()) if how == "inner" else out


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives the memory of its arrays back at the end: workers stay on, idle, beside the next stage's."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return whole


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4. Remainder 2 is held out from learning."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def hashed_share(doc_id: Column, most: int, rows: int) -> Column:
    """If a row is among the about most of rows whose hashed ids are the smallest; every row if there are no more."""
    if rows <= most:
        return F.lit(True)
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < int((1 << 30) * (most / rows))


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that no column of frame has, in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keys(docs: DataFrame, keys: dict[str, Column], found: DataFrame, broadcast_rows: int) -> tuple[DataFrame, Column]:
    names = {c: fresh(docs, f"__{c}") for c in keys}
    ids = found.select(*[F.col(c).alias(names[c]) for c in keys])
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    same = F.lit(True)
    for c, value in keys.items():
        same = same & (value == F.col(names[c]))
    return ids, same


def keep_only(docs: DataFrame, keys: dict[str, Column], dropped: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without the rows whose keys (name in dropped -> expression over docs) are in dropped, one row a key there.

    Up to broadcast_rows keys (of 8 to 24 bytes, some 100 MB as a hash relation) are counted and broadcast;
    more are joined by a shuffle. Rows with a null key stay.
    """
    ids, same = _keys(docs, keys, dropped, broadcast_rows)
    return docs.join(ids, same, "left_anti")


def only(docs: DataFrame, keys: dict[str, Column], wanted: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs whose keys are in wanted, joined as in keep_only."""
    ids, same = _keys(docs, keys, wanted, broadcast_rows)
    return docs.join(ids, same, "left_semi")
