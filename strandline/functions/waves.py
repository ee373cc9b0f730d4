"""Test signals in closed form over a sample's index: exact integers wherever the original is exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def triangle(i: Column, period: int = 64) -> Column:
    """Between -period / 2 and period / 2, in steps of 2."""
    return F.abs(i % period - period // 2) * 2 - period // 2


def square(i: Column, period: int = 50, high: int = 12, level: int = 1000) -> Column:
    return F.when(i % period < high, level).otherwise(-level).cast("long")


def scrambled(i: Column) -> Column:
    """Full-range 16-bit values by an odd multiplier: each appears once in 65,536 samples."""
    return F.shiftright((i * 2654435761).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 16) - 32768


def hash_noise(i: Column, step: int = 40503, modulus: int = 97) -> Column:
    return (i * step) % modulus - modulus // 2


def impulses(i: Column, period: int = 441, level: int = 30000) -> Column:
    return F.when(i % period == 0, level).otherwise(0).cast("long")


def phase(i: Column, increment: int) -> Column:
    """The phase of a 32-bit accumulator: a running sum that is a product here."""
    return (i * increment).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def loud_quiet(i: Column, half: int = 8192, loud: int = 255, quiet: int = 16) -> Column:
    return F.when(F.floor(i / half) % 2 == 0, loud).otherwise(quiet).cast("long")


def harmonics(i: Column, turn: float, level: float, most: float, upto: int = 5) -> Column:
    """Odd harmonics with falling weights, clipped."""
    total = sum((F.sin(i * (turn * h)) / h for h in range(3, upto + 1, 2)), F.sin(i * turn))
    return F.least(F.lit(most), F.greatest(F.lit(-most), level * total))


def tones(i: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Two tones of (level, turn a sample)."""
    return a[0] * F.sin(i * a[1]) + b[0] * F.sin(i * b[1])


def correlated_pair(i: Column, periods: dict[int, int], side_period: int, side_weight: int, noise: tuple[int, int]) -> tuple[Column, Column]:
    """left and right as centre plus and minus side: triangles weighted in thousandths, a square, and noise apart for each."""

    def part(weight: int, wave: Column) -> Column:
        return F.floor((weight * wave) / F.lit(1000)).cast("long")

    centre = sum((part(w, triangle(i, p)) for p, w in periods.items()), part(2, square(i, 32, 16)))
    side = part(side_weight, triangle(i, side_period)) + hash_noise(i, 7919, noise[0])
    return centre + side + hash_noise(i, 104729, noise[1]), centre - side + hash_noise(i, 15485863, noise[1])


def block_noise(spark: SparkSession, n: int, level: float, seed: int, hold: int = 4, rows: int = 1 << 16) -> DataFrame:
    """i, x: seeded noise that is held for hold samples. Each block of rows draws from a stream of its own, so tasks agree with a rerun."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for part in batch["id"]:
                first, last = part * rows, min(n, (part + 1) * rows)
                values = np.random.default_rng([seed, part]).uniform(-level, level, -(-rows // hold))
                yield pd.DataFrame({"i": np.arange(first, last), "x": np.repeat(values, hold)[: last - first]})

    return spark.range(-(-n // rows)).mapInPandas(run, "i long, x double")
