"""Cost accumulators, censuses, code tables, ratios and runs, as aggregations and windows."""

from __future__ import annotations

import heapq
from math import sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.lookup import placed

#: Fixed value: what a counter difference that wrapped is recorded as.
WRAPPED = 4294967295


def cost_columns(cycles: str, frame: str) -> list[Column]:
    """count, least, its first frame, most, its first frame, sum, floor mean, wrapped: one pass, combined before the shuffle."""
    c, f = F.col(cycles), F.col(frame)
    low, high = F.min(F.struct(c, f)), F.max(F.struct(c, -f))
    return [
        F.count(c).alias("frames"), low.getField(cycles).alias("least"), low.getField(frame).alias("least_frame"), high.getField(cycles).alias("most"), (-high.getField("col2")).alias("most_frame"),
        F.sum(c).alias("total"), F.expr(f"sum({cycles}) div count({cycles})").alias("mean"), F.bool_or(c == WRAPPED).alias("wrapped"),
    ]


def pooled_snr(x: Column, y: Column) -> Column:
    """10 log10 of signal to error energy; null where either is 0."""
    s, e = F.sum(x * x), F.sum((x - y) * (x - y))
    return F.when((s > 0) & (e > 0), 10 * F.log10(s / e))


def loudness_weights(frames: DataFrame, track: str, energy: str, out: str = "weight") -> DataFrame:
    """1 / (mean energy + 1) of each track, divided by the geometric mean over all frames; one row a track."""
    tracks = frames.groupBy(track).agg((1 / (F.avg(energy) + 1)).alias("__w"), F.count(F.lit(1)).alias("__n"))
    mean = tracks.agg(F.exp(F.sum(F.ln("__w") * F.col("__n")) / F.sum("__n")).alias("__g"))
    return tracks.join(F.broadcast(mean)).select(track, (F.col("__w") / F.col("__g")).alias(out))  # mean is one row


def bigrams(rows: DataFrame, by: list[str], order: str, symbol: str, start: str) -> DataFrame:
    """Counts of each symbol after each symbol; start precedes the first of a group."""
    prev = F.coalesce(F.lag(symbol).over(Window.partitionBy(*by).orderBy(order)), F.lit(start))
    return rows.select(prev.alias("prev"), F.col(symbol).alias("symbol")).groupBy("prev", "symbol").agg(F.count(F.lit(1)).alias("n"))


def code_lengths(counts: list[float], longest: int = 16, floor: float = 1.0) -> list[int]:
    """Huffman lengths of a table's counts; ties go to the lower index.

    While a code is longer than allowed the counts are flattened to their square root plus the floor.
    """
    counts = [max(float(c), floor) for c in counts]
    if len(counts) < 2:
        return [1] * len(counts)
    while True:
        heap = [(c, i, (i,)) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        lengths, n = [0] * len(counts), len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in (*a[2], *b[2]):
                lengths[i] += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
            n += 1
        if max(lengths) <= longest:
            return lengths
        counts = [sqrt(c) + floor for c in counts]


def train_codes(counts: DataFrame, context: str, symbol: str, n: str, longest: int = 16) -> DataFrame:
    """context, symbol, length: a code for each context. A context's rows are its alphabet, a bounded table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(symbol)
        return pd.DataFrame({context: pdf[context], symbol: pdf[symbol], "length": code_lengths(pdf[n].tolist(), longest)})

    kinds = dict(counts.dtypes)
    return counts.select(context, symbol, n).groupBy(context).applyInPandas(run, f"{context} {kinds[context]}, {symbol} {kinds[symbol]}, length long")


def canonical_codes(lengths: DataFrame, by: list[str], symbol: str, length: str = "length", longest: int = 16) -> DataFrame:
    """Codes in the order of (length, symbol): the running sum of 2 ** (longest - length), shifted down."""
    w = Window.partitionBy(*by).orderBy(length, symbol).rowsBetween(Window.unboundedPreceding, -1)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (longest - F.col(length)).cast("int"))
    before = F.coalesce(F.sum(width).over(w), F.lit(0))
    return lengths.withColumn("code", F.call_function("shiftright", before, (longest - F.col(length)).cast("int")))


def kraft(lengths: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """Per code the Kraft sum and if the code is complete."""
    s = F.sum(F.pow(F.lit(2.0), -F.col(length)))
    return lengths.groupBy(*by).agg(s.alias("kraft"), (F.abs(s - 1) < 1e-9).alias("complete"))


def runs(rows: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Maximal runs of rows for which flag holds: by, first, last, length.

    A run is where the place among all rows and the place among the flagged ones go in step; both are
    counted by ranges, so a hot group is no task's own.
    """
    flagged = placed(placed(rows, by, order, "__n").where(F.col(flag)), by, order, "__m")
    island = (F.col("__n") - F.col("__m")).alias("__g")
    return flagged.groupBy(*by, island).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("__g")


def reasons(**tests: Column) -> Column:
    """The names of the tests that fail; a null test fails. An empty array is a pass."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))
