"""As-of, range and nearest lookups, alignment, interning and comparison, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows written in ranges of order, with __p, the place of their range: no task orders all rows."""
    return materialize(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")


def running_sum(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows before, by a unique order: ranges add up on their own, and one row a range is carried on."""
    dealt = _dealt(rows.withColumn("__v", value), order)
    ranges = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("__p").agg(F.sum("__v").alias("__t")).select("__p", F.coalesce(F.sum("__t").over(ranges), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__s", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return placed.join(F.broadcast(before), "__p").select(*rows.columns, (F.col("__before") + F.col("__s")).cast("long").alias(name))  # one row a range


def numbered(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """rows with their place from 0 in a unique order."""
    return running_sum(rows, order, F.lit(1).cast("long"), name)


def _carried(dealt: DataFrame, total: Column, combine) -> DataFrame:
    """__p, __g, __before: for groups that a range begins or ends with, what earlier ranges have of them; two rows a range at most.

    A group (__g, a struct) that lies inside one range needs nothing carried.
    """
    ends = dealt.groupBy("__p").agg(F.min("__g").alias("a"), F.max("__g").alias("b"))
    cut = ends.select("__p", F.explode(F.array_distinct(F.array("a", "b"))).alias("__g"))
    totals = dealt.join(F.broadcast(cut), ["__p", "__g"]).groupBy("__p", "__g").agg(total.alias("__t"))
    earlier = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__p", "__g", combine("__t").over(earlier).alias("__before")).where("__before is not null")


def placed(rows: DataFrame, by: list[str], order: str, name: str = "n") -> DataFrame:
    """rows with their place from 0 in their group, by a unique order. A hot group is cut over as many ranges as it fills."""
    dealt = _dealt(rows.withColumn("__g", F.struct(*by)), "__g", order)
    inside = Window.partitionBy("__p", "__g").orderBy(order)
    own = dealt.withColumn("__place", (F.row_number().over(inside) - 1).cast("long"))
    before = F.broadcast(_carried(dealt, F.count(F.lit(1)), F.sum))
    return own.join(before, ["__p", "__g"], "left").select(*rows.columns, (F.col("__place") + F.coalesce("__before", F.lit(0))).cast("long").alias(name))


def asof(left: DataFrame, right: DataFrame, by: list[str], key: str, value: list[str]) -> DataFrame:
    """The values of the last right row with right.key <= left.key in each group; null before the first.

    Both sides are dealt out by ranges of (group, key), so a hot group is cut over tasks; in each range
    it is one running last(), and a cut group's last right row before the range is carried into it. Ties
    on the key go to the right side first, and of equal right keys to the largest values.
    """
    a = left.select("*", F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in value], F.lit(False).alias("__hit"))
    b = right.select(*by, key, F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in value], F.lit(True).alias("__hit"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__g", F.struct(*by))
    dealt = _dealt(both, "__g", key, "__side")
    hit = F.when(F.col("__hit"), F.struct(key, *[F.col(f"__{v}") for v in value]))
    w = Window.partitionBy("__p", "__g").orderBy(key, "__side", *[F.col(f"__{v}") for v in value]).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("__own", F.last(hit, ignorenulls=True).over(w)).where("__side = 1")
    before = F.broadcast(_carried(dealt, F.max(hit), F.max))
    last = F.coalesce("__own", "__before")
    return found.join(before, ["__p", "__g"], "left").select(*left.columns, *[last.getField(f"__{v}").alias(v) for v in value])


def asof_all(left: DataFrame, right: DataFrame, key: str, value: list[str]) -> DataFrame:
    """asof of whole tables, as one group that is cut over all ranges."""
    one = F.lit(0).alias("__all")
    return asof(left.select("*", one), right.select("*", one), ["__all"], key, value).drop("__all")


def range_of(points: DataFrame, spans: DataFrame, key: str, start: str, stop: str, take: list[str]) -> DataFrame:
    """Each point with the span start <= key < stop, spans being disjoint: an as-of lookup and a filter."""
    found = asof_all(points, spans.withColumn(key, F.col(start)), key, [start, stop, *take])
    return found.where(F.col(key) < F.col(stop))


def nearest(rows: DataFrame, dimension: list[dict], score, take: list[str]) -> DataFrame:
    """For each row the entry of a fixed dimension with the smallest score tuple, ties by take.

    score maps an entry to columns. The dimension is part of the expression, so nothing is joined.
    """
    entries = [F.struct(*[s.alias(f"__s{i}") for i, s in enumerate(score(d))], *[F.lit(d[t]).alias(t) for t in take]) for d in dimension]
    best = rows.withColumn("__b", F.array_min(F.array(*entries)))
    return best.select(*rows.columns, *[F.col(f"__b.{t}").alias(t) for t in take])


def alignment(signal: DataFrame, reference: DataFrame, key: str, at: str, value: str, shifts: range, anchor: int) -> DataFrame:
    """Per key the shift with the fewest differing places, ties to the one nearest the anchor, then the smaller."""
    moved = reference.select(key, F.col(at).alias("__j"), F.col(value).alias("__v")).withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    joined = moved.join(signal, (moved[key] == signal[key]) & (F.col("__j") + F.col("shift") == F.col(at)))
    counts = joined.groupBy(moved[key].alias(key), "shift").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.when(F.col(value) != F.col("__v"), 1).otherwise(0)).alias("mismatches"), F.max(F.abs(F.col(value) - F.col("__v"))).alias("largest"))
    full = counts.join(reference.groupBy(key).agg(F.count(F.lit(1)).alias("__all")), key).where("__n = __all")
    best = full.groupBy(key).agg(F.min(F.struct("mismatches", F.abs(F.col("shift") - anchor).alias("off"), "shift", "largest")).alias("__b"))
    return best.select(key, *[F.col(f"__b.{c}").alias(c) for c in ("shift", "mismatches", "largest")])


def intern(strings: DataFrame, text: str, position: str) -> tuple[DataFrame, DataFrame]:
    """A string pool: distinct strings in the order of their first use with byte offsets, and each use's offset."""
    first = strings.groupBy(text).agg(F.min(position).alias("first"))
    pool = running_sum(first, "first", F.octet_length(text) + 1, "offset")
    return pool, strings.join(pool.select(text, "offset"), text)


def compare(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys on which two tables differ, null-safe, with what differs."""
    a = left.select(*keys, *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(True).alias("__a"))
    b = right.select(*keys, *[F.col(v).alias(f"__b_{v}") for v in values], F.lit(True).alias("__b"))
    both = a.join(b, keys, "full")
    wrong = [F.when(~F.col(f"__a_{v}").eqNullSafe(F.col(f"__b_{v}")), F.lit(v)) for v in values]
    reason = F.when(F.col("__a").isNull(), F.array(F.lit("missing left"))).when(F.col("__b").isNull(), F.array(F.lit("missing right"))).otherwise(F.array_compact(F.array(*wrong)))
    return both.withColumn("reasons", reason).where(F.size("reasons") > 0).select(*keys, "reasons")
