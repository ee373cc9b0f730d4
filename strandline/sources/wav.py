"""WAV files and raw sample pairs as tables, and their writers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Every depth is read on the scale of 16-bit samples.
FULL_SCALE = 32768.0
INFO_TAGS = {b"INAM": "title", b"IART": "artist", b"IPRD": "album"}


class WavError(ValueError):
    pass


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    """(id, body) of RIFF chunks; a body is padded to an even length."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise WavError(f"chunk {name!r} declares {size} bytes, {end - at - 8} are left")
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def info_tags(body: bytes) -> dict[str, str]:
    """Title, artist and album of a LIST chunk of type INFO; the first of each counts."""
    out: dict[str, str] = {}
    if body[:4] == b"INFO":
        for name, value in chunks(body, 4, len(body)):
            if name in INFO_TAGS:
                text = value.split(b"\0")[0].decode("utf-8", "replace").strip()
                if text:
                    out.setdefault(INFO_TAGS[name], text)
    return out


def parse(data: bytes) -> dict:
    """rate, channels, bits, samples (frames x channels float32) and tags. Raises WavError."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise WavError("no RIFF/WAVE header")
    form, body, tags = None, None, {}
    for name, part in chunks(data, 12, len(data)):
        if name == b"fmt ":
            form = part
        elif name == b"data":
            if body is not None:
                raise WavError("two data chunks")
            body = part
        elif name == b"LIST":
            tags = info_tags(part) | tags
    if form is None or body is None or len(form) < 16:
        raise WavError("no fmt or data chunk")
    kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", form)
    if kind == 0xFFFE:
        if len(form) < 40:
            raise WavError("an extensible header without its extension")
        kind = struct.unpack_from("<H", form, 24)[0]
    if channels not in (1, 2) or rate == 0 or (kind, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32)):
        raise WavError(f"format {kind}, {channels} channels, {bits} bits, {rate} Hz")
    if block != channels * bits // 8 or len(body) % block:
        raise WavError("the block size doesn't fit the format or the data")
    if kind == 3:
        x = np.frombuffer(body, "<f4") * np.float32(FULL_SCALE)
        if not np.isfinite(x).all():
            raise WavError("samples that aren't finite")
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) * 256
    elif bits == 16:
        x = np.frombuffer(body, "<i2").astype(np.float32)
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8) >> 8).astype(np.float32) / 256
    else:
        x = np.frombuffer(body, "<i4").astype(np.float32) / 65536
    return {"rate": rate, "channels": channels, "bits": bits, "samples": x.reshape(-1, channels), "tags": tags}


def build(samples: np.ndarray, rate: int, tags: dict[str, str] | None = None) -> bytes:
    """A 16-bit file of integer samples (frames x channels); of 32-bit floats where a sample doesn't fit 16 bits."""
    channels, fits = samples.shape[1], not samples.size or -32768 <= samples.min() and samples.max() <= 32767
    kind, size = (1, 2) if fits else (3, 4)
    body = (np.ascontiguousarray(samples, "<i2") if fits else np.ascontiguousarray(samples, "<f4") / np.float32(FULL_SCALE)).tobytes()
    parts = [b"fmt " + struct.pack("<IHHIIHH", 16, kind, channels, rate, rate * channels * size, channels * size, 8 * size), b"data" + struct.pack("<I", len(body)) + body]
    if tags:
        names = {v: k for k, v in INFO_TAGS.items()}
        info = b"INFO"
        for k, v in tags.items():
            raw = v.encode() + b"\0"
            info += names[k] + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
        parts.append(b"LIST" + struct.pack("<I", len(info)) + info)
    return b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + b"WAVE" + b"".join(parts)


def read(files: DataFrame, rows: int = 65_536, strict: bool = True) -> DataFrame:
    """files (path, content) -> path, start, rate, channels, bits, left, right, title, artist, error: blocks of at most rows samples.

    Mono fills both sides. A file without a title takes its name; without samples it still gives a row.
    """
    schema = "path string, start long, rate int, channels int, bits int, left array<float>, right array<float>, title string, artist string, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    w = parse(bytes(content))
                except WavError as error:
                    if strict:
                        raise WavError(f"{path}: {error}") from error
                    yield pd.DataFrame([(path, *[None] * 8, str(error))], columns=names)
                    continue
                x = w["samples"]
                for at in range(0, max(len(x), 1), rows):
                    part = x[at : at + rows]
                    title = w["tags"].get("title") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0] or "?"
                    yield pd.DataFrame([(path, at, w["rate"], w["channels"], w["bits"], part[:, 0], part[:, -1], title, w["tags"].get("artist") or "?", None)], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def samples(blocks: DataFrame) -> DataFrame:
    """path, i, left, right."""
    each = blocks.where("error is null").select("path", "start", F.posexplode(F.arrays_zip("left", "right")).alias("__i", "__x"))
    return each.select("path", (F.col("start") + F.col("__i")).alias("i"), F.col("__x.left").alias("left"), F.col("__x.right").alias("right"))


TRACKS = "n int, start long, len long, title string, artist string"


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated track list with # comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema=TRACKS, quote="", mode="FAILFAST")


def write_tracks(tracks: DataFrame, path: str) -> None:
    tracks.select("n", "start", "len", "title", "artist").write.csv(path, sep="\t", quote="", mode="overwrite")


def track_faults(tracks: DataFrame, most: int = 32, total: Column | None = None) -> DataFrame:
    """Rows that aren't numbered from 1, overlap the one before, or hold a NUL, with reasons. A list has at most 32 rows."""
    w = Window.orderBy("n")
    t = tracks.withColumn("__k", F.row_number().over(w)).withColumn("__end", F.lag(F.col("start") + F.col("len")).over(w))
    wrong = F.array_compact(
        F.array(
            F.when(F.col("n") != F.col("__k"), "number"), F.when(F.col("start") < F.col("__end"), "overlap"), F.when(F.col("__k") > most, "too many"),
            F.when(F.concat("title", "artist").contains("\x00"), "nul"), F.when(F.col("len") <= 0, "empty"), F.when(F.col("start") + F.col("len") > total, "beyond the end") if total is not None else F.lit(None),
        )
    )
    return t.withColumn("reasons", wrong).where(F.size("reasons") > 0).select("n", "reasons")


def read_pairs(files: DataFrame, rows: int = 65_536) -> DataFrame:
    """Raw interleaved stereo float32: path, start, left, right in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if len(content) % 8:
                    raise WavError(f"{path}: {len(content)} bytes are no whole pairs")
                x = np.frombuffer(bytes(content), "<f4").reshape(-1, 2)
                for at in range(0, len(x), rows):
                    yield pd.DataFrame({"path": [path], "start": [at], "left": [x[at : at + rows, 0]], "right": [x[at : at + rows, 1]]})

    return files.select("path", "content").mapInPandas(run, "path string, start long, left array<float>, right array<float>")


def pair_bytes(left: Iterator[float] | list[float], right: Iterator[float] | list[float]) -> bytes:
    """Interleaved 32-bit floats, as read_pairs takes them."""
    return np.stack([np.asarray(left, "<f4"), np.asarray(right, "<f4")], 1).tobytes()
