"""Text inputs: album configurations, processing recipes, encoder logs, expected-value tables."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALBUM = "title string, artist string, year int, rate int, cart_bytes long"
TRACK = "idx int, file string, title string, artist string, start_sample long, end_sample long"
#: The sections a configuration may have, the product's rate, most tracks.
SECTIONS, RATE, TRACKS = {"album", "track", "out"}, 16384, 32


class ConfigError(ValueError):
    pass


def _whole(value, what: str, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ConfigError(f"{what} is {value!r}")
    return value


def read_config(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Album (one row) and tracks of a configuration. Unknown sections and half windows are refused."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(str(error)) from error
    if set(doc) - SECTIONS:
        raise ConfigError(f"unknown sections {sorted(set(doc) - SECTIONS)}")
    album, out, tracks = doc.get("album", {}), doc.get("out", {}), doc.get("track", [])
    if not album.get("title"):
        raise ConfigError("no album title")
    rate = _whole(out.get("rate_hz", RATE), "rate_hz", RATE, RATE)
    if not 1 <= len(tracks) <= TRACKS:
        raise ConfigError(f"{len(tracks)} tracks")
    rows = []
    for i, t in enumerate(tracks):
        first, last = t.get("start_sample"), t.get("end_sample")
        if not str(t.get("file", "")).strip():
            raise ConfigError(f"track {i} has no file")
        if (first is None) != (last is None):
            raise ConfigError(f"track {i} has half a window")
        if first is not None and _whole(last, "end_sample", 0, 1 << 62) <= _whole(first, "start_sample", 0, 1 << 62):
            raise ConfigError(f"track {i} ends before it starts")
        rows.append((i, t["file"], t.get("title"), t.get("artist"), first, last))
    head = (album["title"], album.get("artist", ""), _whole(album.get("year", 0), "year", 0, 65535), rate, _whole(out.get("cart_bytes", 1 << 25), "cart_bytes", 1, 1 << 40))
    return spark.createDataFrame([head], ALBUM), spark.createDataFrame(rows, TRACK)


def recipe(text: Column) -> list[Column]:
    """trim_start, trim_end (null: to the end) and fade_out seconds of a recipe such as 'trim 1.5-end s, 2s fade-out'."""
    text = F.coalesce(text, F.lit(""))
    start, end, fade = F.regexp_extract(text, r"trim\s+([0-9.]+)-(?:end|[0-9.]+)\s*s", 1), F.regexp_extract(text, r"trim\s+[0-9.]+-([0-9.]+)\s*s", 1), F.regexp_extract(text, r"([0-9.]+)s\s+fade-out", 1)
    number = lambda c: F.when(c != "", c.try_cast("double"))
    return [F.coalesce(number(start), F.lit(0.0)).alias("trim_start"), number(end).alias("trim_end"), F.coalesce(number(fade), F.lit(0.0)).alias("fade_out")]


def apply_recipe(signal: DataFrame, at: str, x: str, rate: int, start: float, end: float | None, fade: float, gain: float = 1.0) -> DataFrame:
    """Samples of the window, renumbered, with gain and a linear fade over its last seconds."""
    first = round(start * rate)
    inside = signal.where(F.col(at) >= first)
    if end is not None:
        inside = inside.where(F.col(at) < round(end * rate))
    n = inside.agg((F.max(at) - first + 1).alias("__n"))  # one row
    placed = inside.withColumn(at, F.col(at) - first).join(F.broadcast(n))
    ramp = F.least(F.lit(1.0), (F.col("__n") - F.col(at)) / max(fade * rate, 1.0)) if fade else F.lit(1.0)
    return placed.withColumn(x, F.col(x) * gain * ramp).drop("__n")


def encoder_log(text: Column) -> list[Column]:
    """kbit, snr, g_low, g_high, lambda of an encoder's report, null where a figure isn't there."""
    pick = lambda pattern, group, kind: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group).cast(kind))
    return [
        pick(r"([0-9]+\.[0-9]+) kbit/s", 1, "double").alias("kbit"), pick(r"SNR\s+([0-9]+\.[0-9]+)", 1, "double").alias("snr"),
        pick(r"g searched ([0-9]+)\.\.([0-9]+)", 1, "int").alias("g_low"), pick(r"g searched ([0-9]+)\.\.([0-9]+)", 2, "int").alias("g_high"), pick(r"lambda ([0-9.e+-]+)", 1, "double").alias("lambda"),
    ]


def compare_encoders(one: DataFrame, other: DataFrame, budget: str = "budget") -> DataFrame:
    """budget, gained_db, bytes_ratio, both_fit of two result tables (budget, bytes, snr)."""
    a, b = (t.select(budget, F.col("bytes").alias(f"__{n}b"), F.col("snr").alias(f"__{n}s")) for t, n in ((one, "a"), (other, "b")))
    return a.join(b, budget, "full").select(
        budget, F.round(F.col("__as") - F.col("__bs"), 6).alias("gained_db"), F.round(F.col("__ab") / F.col("__bb"), 6).alias("bytes_ratio"),
        F.coalesce((F.col("__ab") <= F.col(budget)) & (F.col("__bb") <= F.col(budget)), F.lit(False)).alias("both_fit"),
    )


def key_values(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of blank-separated key=value lines as maps, with their line numbers; comments and blank lines are left out."""
    kept = lines.where(F.trim(column) != "").where(~F.col(column).startswith("#"))
    return kept.select(F.str_to_map(F.col(column), F.lit(" "), F.lit("=")).alias("fields"))
