"""Integer prediction over ordered blocks: fixed and linear predictors, Rice costs, wasted bits, stereo.

A signal is a table with group columns, a place i within the group and an integer sample x. Forward
prediction and fixed integration are windows over the group; only the inverse linear predictor is a
recursion and runs as an Arrow function on whole blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.bits import trailing_zeros, zigzag
from strandline.operators.lookup import placed

#: The differences that the predictors of order 0 to 4 take.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def blocks(signal: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds blk and i: consecutive blocks of size samples within a group. A hot group's places are counted by ranges."""
    return placed(signal, [group], order, "__n").withColumn("blk", F.expr(f"__n div {size}").cast("long")).withColumn("i", (F.col("__n") % size).cast("long")).drop("__n")


def fixed_residual(signal: DataFrame, order: int, by: list[str], at: str = "i", x: str = "x", out: str = "e") -> DataFrame:
    """Residual of the fixed predictor; the first order samples of a group have none and are left out."""
    w = Window.partitionBy(*by).orderBy(at)
    guess = sum((c * F.lag(x, k).over(w) for k, c in enumerate(FIXED[order], 1)), F.lit(0))
    return signal.withColumn(out, F.col(x) - guess).where(F.col(at) >= order)


def all_fixed_residuals(signal: DataFrame, by: list[str], at: str = "i", x: str = "x") -> DataFrame:
    """Residuals of every order 0 to 4 as rows (ord, e), from one window pass."""
    w = Window.partitionBy(*by).orderBy(at)
    lags = [F.lag(x, k).over(w) for k in range(1, 5)]
    orders = F.array(*[F.struct(F.lit(o).alias("ord"), (F.col(x) - sum((c * lags[k] for k, c in enumerate(FIXED[o])), F.lit(0))).alias("e")) for o in range(5)])
    return signal.select(*by, at, orders.alias("__o")).select(*by, at, F.explode("__o").alias("__o")).select(*by, at, F.col("__o.ord").alias("ord"), F.col("__o.e").alias("e")).where(F.col(at) >= F.col("ord"))


def integrate_fixed(residual: DataFrame, order: int, by: list[str], at: str = "i", e: str = "e", out: str = "y") -> DataFrame:
    """Inverse of fixed_residual as running sums, one per order.

    Warm-up rows carry, in e, the difference of as many orders as there are samples before them.
    """
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    level = residual.withColumn("__0", F.col(e))
    for k in range(order):
        # At level k the first order - 1 - k rows hold lower differences: they are taken as they are.
        kept = F.when(F.col(at) < order - 1 - k, F.lit(0)).otherwise(F.col(f"__{k}"))
        level = level.withColumn(f"__{k + 1}", F.when(F.col(at) < order - 1 - k, F.col(f"__{k}")).otherwise(F.sum(kept).over(w)))
    return level.withColumn(out, F.col(f"__{order}")).drop(*[f"__{k}" for k in range(order + 1)])


def warm_residual(signal: DataFrame, order: int, by: list[str], at: str = "i", x: str = "x", out: str = "e") -> DataFrame:
    """fixed_residual with the warm-up rows that integrate_fixed needs."""
    w = Window.partitionBy(*by).orderBy(at)
    e = F.col(x)
    for o in range(1, order + 1):
        guess = sum((c * F.lag(x, k).over(w) for k, c in enumerate(FIXED[o], 1)), F.lit(0))
        e = F.when(F.col(at) >= o, F.col(x) - guess).otherwise(e)
    return signal.withColumn(out, e)


def lpc_residual(signal: DataFrame, coefficients: list[int], shift: int, by: list[str], at: str = "i", x: str = "x", out: str = "e") -> DataFrame:
    """Residual of a linear predictor, newest sample first; the warm-up rows keep the sample."""
    w = Window.partitionBy(*by).orderBy(at)
    guess = F.shiftright(sum((F.lit(c) * F.lag(x, k).over(w) for k, c in enumerate(coefficients, 1)), F.lit(0)), shift)
    return signal.withColumn(out, F.when(F.col(at) < len(coefficients), F.col(x)).otherwise(F.col(x) - guess))


def integrate_lpc_samples(residual: list[int], coefficients: list[int], shift: int, bits: int | None = None) -> list[int]:
    """One block's samples from warm-up and residual; bits wraps to that width."""
    out: list[int] = []
    order = len(coefficients)
    for i, e in enumerate(residual):
        if i >= order:
            e += sum(c * out[i - 1 - k] for k, c in enumerate(coefficients)) >> shift
        if bits:
            e = ((e + (1 << (bits - 1))) & ((1 << bits) - 1)) - (1 << (bits - 1))
        out.append(e)
    return out


def integrate_lpc_blocks(blocks_: list[np.ndarray], coefficients: list[int], shift: int, bits: int | None = None) -> list[np.ndarray]:
    """integrate_lpc_samples of many blocks side by side: one step over arrays for each place in a block."""
    order, sizes = len(coefficients), [len(b) for b in blocks_]
    x = np.zeros((order + max(sizes, default=0), len(blocks_)), np.int64)  # places x blocks, with order zeros before
    for j, b in enumerate(blocks_):
        x[order : order + sizes[j], j] = b
    weights = np.array(coefficients[::-1], np.int64)
    for i in range(len(x) - order):
        row = x[order + i]
        if i >= order:
            row += weights @ x[i : i + order] >> shift
        if bits:
            row[:] = ((row + (1 << (bits - 1))) & ((1 << bits) - 1)) - (1 << (bits - 1))
    return [x[order : order + n, j] for j, n in enumerate(sizes)]


def integrate_lpc(blocks_: DataFrame, coefficients: list[int], shift: int, column: str = "residuals", out: str = "samples", bits: int | None = None) -> DataFrame:
    """Inverse of lpc_residual on arrays, a block a row: a recursion, hence an Arrow function. bits wraps to that width."""

    @F.pandas_udf("array<bigint>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(integrate_lpc_blocks([np.asarray(v, np.int64) for v in values], coefficients, shift, bits))

    return blocks_.withColumn(out, run(column))


def integrate_fixed_wrapped(residual: DataFrame, order: int, by: list[str], at: str = "i", e: str = "e", out: str = "y", bits: int = 32) -> DataFrame:
    """integrate_fixed in arithmetic of bits: running sums wrap at the end alone, as wrapping commutes with adding."""
    whole = integrate_fixed(residual, order, by, at, e, out)
    half = F.lit(1 << (bits - 1)).cast("long")
    return whole.withColumn(out, (F.col(out) + half).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) - half)


def accumulator_fits(coefficients: Column, bits: int) -> Column:
    """If a dot product with samples of that width stays within 32 bits."""
    total = F.aggregate(coefficients, F.lit(0).cast("long"), lambda s, c: s + F.abs(c).cast("long"))
    return total * (1 << (bits - 1)) <= 2147483647


def rice_costs(residual: DataFrame, by: list[str], parameters: int = 15, e: str = "e") -> DataFrame:
    """Bits of each group under each parameter: one map-side combined aggregation, no join."""
    sums = [F.sum(F.shiftright(zigzag(F.col(e)), k) + 1 + k).alias(f"__{k}") for k in range(parameters)]
    wide = residual.groupBy(*by).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__{k}").alias("bits")) for k in range(parameters)]))
    return wide.select(*by, each.alias("__c")).select(*by, F.col("__c.k").alias("k"), F.col("__c.bits").alias("bits"))


def first_least(costs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each group with the smallest tuple of order; an aggregation, so it combines before the shuffle."""
    best = costs.groupBy(*by).agg(F.min(F.struct(*order)).alias("__b"))
    return best.select(*by, *[F.col(f"__b.{c}").alias(c) for c in order])


def wasted_bits(signal: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Low bits that are 0 in all samples of a group; null if all are 0."""
    return signal.groupBy(*by).agg(trailing_zeros(F.bit_or(x)).cast("long").alias("wasted"))


def decorrelate(left: Column, right: Column) -> dict[str, tuple[Column, Column]]:
    """Both slots of each stereo mode."""
    side = left - right
    return {"independent": (left, right), "left_side": (left, side), "side_right": (side, right), "mid_side": (F.shiftright(left + right, 1), side)}


def recombine(mode: str, a: Column, b: Column) -> tuple[Column, Column]:
    if mode == "independent":
        return a, b
    if mode == "left_side":
        return a, a - b
    if mode == "side_right":
        return a + b, b
    mid = F.shiftleft(a, 1).bitwiseOR(b.bitwiseAND(F.lit(1).cast("long")))
    return F.shiftright(mid + b, 1), F.shiftright(mid - b, 1)
