"""Lapped transforms and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dct4(x: np.ndarray) -> np.ndarray:
    """Orthonormal DCT-IV of the last axis, by one complex FFT of half its length."""
    n = x.shape[-1]
    k = np.arange(n // 2)
    z = (x[..., ::2] + 1j * x[..., ::-1][..., ::2]) * np.exp(-1j * np.pi * (k + 0.25) / n)
    y = np.fft.fft(z, axis=-1) * np.exp(-1j * np.pi * k / n)
    out = np.empty_like(x, float)
    out[..., ::2], out[..., ::-1][..., ::2] = y.real, -y.imag
    return out * np.sqrt(2 / n)


def sine_window(hop: int) -> np.ndarray:
    return np.sin(np.pi / (2 * hop) * (np.arange(2 * hop) + 0.5))


def mdct(frames: np.ndarray) -> np.ndarray:
    """Coefficients of windowed frames of two hops: the fold to one hop, then DCT-IV."""
    hop = frames.shape[-1] // 2
    half = hop // 2
    a, b, c, d = (frames[..., i * half : (i + 1) * half] for i in range(4))
    return dct4(np.concatenate([-c[..., ::-1] - d, a - b[..., ::-1]], -1))


def imdct(coefficients: np.ndarray) -> np.ndarray:
    """Two hops per frame, to be windowed and overlapped."""
    hop = coefficients.shape[-1]
    half = hop // 2
    y = dct4(coefficients)
    p, q = y[..., :half], y[..., half:]
    return np.concatenate([q, -q[..., ::-1], -p[..., ::-1], -p], -1)


def framed(signal: DataFrame, hop: int, by: list[str], at: str, x: str) -> DataFrame:
    """Frame f of each group holds samples (f - 1) * hop up to (f + 1) * hop, zeros outside: every sample goes to two frames."""
    f = F.floor(F.col(at) / hop).cast("long")
    return signal.select(*by, F.explode(F.array(f, f + 1)).alias("frame"), F.col(at).alias("__at"), F.col(x).alias("__x"))


def analyse(signal: DataFrame, hop: int, by: list[str], at: str = "n", x: str = "x", kept: int | None = None) -> DataFrame:
    """by, frame, coef: MDCT coefficients of each frame. A frame is two hops of samples, whatever the group's size."""
    keep = hop if kept is None else kept
    window = sine_window(hop)
    rows = framed(signal, hop, by, at, x).groupBy(*by, "frame").agg(F.collect_list(F.struct((F.col("__at") - (F.col("frame") - 1) * hop).cast("int").alias("i"), F.col("__x").cast("double").alias("x"))).alias("s"))

    @F.pandas_udf("array<double>")
    def run(i: pd.Series, v: pd.Series) -> pd.Series:
        frames = np.zeros((len(i), 2 * hop))
        for r, (at_, x_) in enumerate(zip(i, v, strict=True)):
            frames[r, at_] = x_
        return pd.Series(list(mdct(frames * window)[:, :keep]))

    return rows.select(*by, "frame", run(F.col("s.i"), F.col("s.x")).alias("coef"))


def synthesise(coefficients: DataFrame, hop: int, by: list[str], out: str = "y") -> DataFrame:
    """by, n, y: windowed inverse transforms, overlapped by a sum over the two frames of a sample."""
    window = sine_window(hop)

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        full = np.zeros((len(values), hop))
        for r, v in enumerate(values):
            full[r, : len(v)] = v
        return pd.Series(list(imdct(full) * window))

    parts = coefficients.select(*by, "frame", F.posexplode(run(F.col("coef"))).alias("i", "v"))
    return parts.select(*by, ((F.col("frame") - 1) * hop + F.col("i")).alias("n"), "v").groupBy(*by, "n").agg(F.sum("v").alias(out)).where("n >= 0")


def resample_taps(signal: DataFrame, up: int, down: int, taps: dict[int, tuple[int, ...]], by: list[str], at: str, x: str, out: str = "y") -> DataFrame:
    """by, j, y: sum over k of taps[phase][k] * x[j * down div up + k], zeros outside; n * up div down outputs a group."""
    width = max(map(len, taps.values()))
    lengths = signal.groupBy(*by).agg(F.expr(f"count(*) * {up} div {down}").alias("__m")).where("__m > 0")
    outputs = lengths.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1)).alias("j"))
    phase: Column = (F.col("j") * down % up).cast("int")
    table = F.array(*[F.array(*[F.lit(t) for t in taps[p]]) for p in range(up)])
    each = outputs.select(*by, "j", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("__k")).withColumn("__tap", F.get(F.get(table, phase), F.col("__k"))).withColumn(at, F.expr(f"j * {down} div {up}") + F.col("__k"))
    joined = each.join(signal.select(*by, at, F.col(x).alias("__x")), [*by, at], "left")
    return joined.groupBy(*by, "j").agg(F.sum(F.col("__tap") * F.coalesce("__x", F.lit(0))).alias(out))


def kaiser_taps(up: int, down: int, half: int = 16, beta: float = 8.0) -> dict[int, np.ndarray]:
    """Polyphase windowed-sinc taps: for each phase the 2 * half weights of the inputs around its place, summing to 1."""
    cut = min(1.0, up / down)
    out = {}
    for p in range(up):
        at = np.arange(-half + 1, half + 1) - p / up
        w = np.i0(beta * np.sqrt(np.maximum(1 - (at / half) ** 2, 0))) / np.i0(beta)
        h = np.sinc(at * cut) * cut * w
        out[p] = h / h.sum()
    return out
