"""Rate-distortion: quantisers, class choice, rate curves, allocation and the best path through classes."""

from __future__ import annotations

from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bisection's range and steps on ln(lambda), and side information per frame.
LOW, HIGH, STEPS, SIDE_BITS = -25.0, 40.0, 64, 3.5


def quantise(x: Column, step: Column, offset: float = 3 / 16, most: int = 65535) -> Column:
    """Magnitude whose reconstruction (m - offset) * step is nearest to |x| among 0, floor and floor + 1; zero first on ties."""
    a = F.abs(x)
    f = F.least(F.floor(a / step), F.lit(most)).cast("long")

    def error(m):
        e = a - F.when(m == 0, F.lit(0.0)).otherwise((m - offset) * step)
        return e * e

    tries = [F.struct(error(F.lit(0).cast("long")).alias("e"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("m")), F.struct(error(f).alias("e"), F.lit(1).alias("o"), f.alias("m")), F.struct(error(f + 1).alias("e"), F.lit(2).alias("o"), F.least(f + 1, F.lit(most)).alias("m"))]
    return F.array_min(F.array(*tries))["m"]


def class_of(largest: Column, headroom: list[int]) -> Column:
    """The lowest class whose headroom holds the largest magnitude; 0 for none, the last one for too much."""
    out = F.when(largest <= 0, 0)
    for c, h in enumerate(headroom[1:], 1):
        out = out.when(largest <= h, c)
    return out.otherwise(len(headroom) - 1)


def extra_bits(m: Column, raw: int, escape: int) -> Column:
    """Bits of a magnitude besides its symbol: escape from 15 on, raw low bits, sign."""
    from strandline.functions.bits import golomb_bits

    head = F.shiftright(m, raw)
    return F.when(head >= 15, golomb_bits(head - 15, escape)).otherwise(0) + raw + F.when(m != 0, 1).otherwise(0)


def pick(curve: DataFrame, by: str, lam: float, cap: float | None = None, weight: str | None = None) -> DataFrame:
    """Per frame the candidate with the least weight * d + lambda * r whose cycles are within the cap; the lower g on ties."""
    allowed = curve if cap is None else curve.where(F.col("c") <= cap)
    d = F.col("d") * (F.col(weight) if weight else 1.0)
    best = allowed.groupBy(by).agg(F.min(F.struct((d + lam * F.col("r")).alias("j"), "g", "r", "d")).alias("b"))
    return best.select(by, *[F.col(f"b.{c}").alias(c) for c in ("g", "r", "d")])


def allocate(curve: DataFrame, by: str, target_bits: float, cap: float | None = None, grid: int = 33, weight: str | None = None) -> tuple[float, DataFrame]:
    """The lambda at which the chosen bits just fit the target, and the choice.

    The bisection over ln(lambda) is done by grids: one aggregation gives the bits at every point of a
    grid, and the next grid lies between the last point that doesn't fit and the first that does. Two
    or three jobs replace the 64 of a plain bisection, over curves that should be materialised. weight
    names a column that the distortion is multiplied by.
    """
    frames = curve.select(by).distinct().count()
    target = target_bits - SIDE_BITS * frames
    allowed = curve if cap is None else curve.where(F.col("c") <= cap)
    if allowed.select(by).distinct().count() != frames:
        raise ValueError("a frame has no candidate within the cap")
    d = F.col("d") * (F.col(weight) if weight else 1.0)
    lo, hi = LOW, HIGH
    while hi - lo > (HIGH - LOW) / 2**40:
        points = [lo + (hi - lo) * i / (grid - 1) for i in range(grid)]
        picks = [F.min(F.struct((d + exp(p) * F.col("r")).alias("j"), "g", "r"))["r"].alias(f"r{i}") for i, p in enumerate(points)]
        bits = allowed.groupBy(by).agg(*picks).agg(*[F.sum(f"r{i}") for i in range(grid)]).first()
        fits = [i for i in range(grid) if bits[i] <= target]
        if not fits:
            raise ValueError(f"the smallest choice takes {bits[grid - 1]} bits, {target} are there")
        if fits[0] == 0:
            return exp(lo), pick(curve, by, exp(lo), cap, weight)
        lo, hi = points[fits[0] - 1], points[fits[0]]
    return exp(hi), pick(curve, by, exp(hi), cap, weight)


def best_path(costs: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[list[int], float]:
    """Cheapest class of every band: costs (bands, classes), moves (from, to), start; the lowest class on ties."""
    total = start + costs[0]
    back = []
    for row in costs[1:]:
        via = total[:, None] + moves
        back.append(via.argmin(0))
        total = via.min(0) + row
    at = int(total.argmin())
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return path[::-1], float(total.min())


def best_paths(frames: DataFrame, key: str, column: str, moves: np.ndarray, start: np.ndarray) -> DataFrame:
    """key, path, cost of rows whose column holds bands * classes costs, band by band. Rows are independent; a row is a recursion."""
    k = len(start)

    @F.pandas_udf("struct<path:array<int>,cost:double>")
    def run(values: pd.Series) -> pd.DataFrame:
        found = [best_path(np.asarray(v, float).reshape(-1, k), moves, start) for v in values]
        return pd.DataFrame({"path": [p for p, _ in found], "cost": [c for _, c in found]})

    return frames.select(key, run(F.col(column)).alias("__p")).select(key, "__p.path", "__p.cost")
