"""Audits that give lists of problems, facts and pins of packed assets, and profiles that refuse.

Nothing here trusts a writer: every field is read from the bytes again and held against what the frames
themselves say. An empty list is a pass.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.digest import FNV32, FNV64, crc_of, fnv_of
from strandline.operators.stats import reasons
from strandline.sources import containers, flac
from strandline.sources.bitio import Short

_REFUSED = (flac.FlacError, containers.ContainerError, Short, struct.error, UnicodeDecodeError, IndexError)


def gafp_problems(blob: bytes, source: bytes) -> list[str]:
    """What is wrong with a GAFP container of a FLAC stream's frames."""
    info, start = flac.facts(source)
    rows = list(flac.walk(source))
    order = max((s["order"] for r in rows for s in r["subframes"] if s["kind"] == "fixed"), default=0)
    n = len(rows)
    if len(blob) < 28 + 4 * n:
        return [f"{len(blob)} bytes don't hold the header and {n} offsets"]
    version, channels, bits, recorded, block, rate, samples, frames, first = struct.unpack_from("<BBBBHIQHI", blob, 4)
    told = {
        "magic": blob[:4] == b"GAFP", "version": version == 1, "channels or bits": (channels, bits) == (info.channels, info.bits), "recorded order": recorded == order, "frame count": frames == n,
        "frame data offset": first == 28 + 4 * n, "block size": block == info.most_block, "rate": rate == info.rate, "samples": samples == (info.samples or samples),
    }
    bad = [name for name, ok in told.items() if not ok]
    offsets = list(struct.unpack_from(f"<{n}I", blob, 28))
    if any(a >= b for a, b in zip(offsets, offsets[1:], strict=False)) or offsets and offsets[0] != 28 + 4 * n:
        bad.append("offset table")
    if blob[28 + 4 * n :] != source[start:]:
        bad.append("frame region")
    for i, (a, b) in enumerate(zip(offsets, [*offsets[1:], len(blob)], strict=True)):
        if b - a != rows[i]["bytes"]:
            bad.append(f"slice {i}: size")
            continue
        try:
            head = flac.frame_header(blob, a, info)
        except _REFUSED:
            bad.append(f"slice {i}: header")
            continue
        bad += [f"slice {i}: {what}" for what, ok in (("number", head.number == i), ("block", head.block == rows[i]["head"].block), ("checksum", crc_of("crc16", blob[a : b - 2]) == int.from_bytes(blob[b - 2 : b], "big"))) if not ok]
    if sum(r["head"].block for r in rows) != samples:
        bad.append("the frames' blocks don't add up")
    return bad


def albm_problems(blob: bytes) -> list[str]:
    """What is wrong with an ALBM album, all of it and not the first refusal alone."""
    if len(blob) < 64:
        return ["shorter than its header"]
    version, n, backend, zero, rate, cells, samples, track_off, track_len, pool_off, pool_len, asset_off, asset_len, seal, title, artist, _ = struct.unpack_from("<4B10I3H", blob, 4)
    sections = (track_off, track_len, pool_off, pool_len, asset_off)
    told = {
        "magic": blob[:4] == b"ALBM", "reserved byte 7": zero == 0, "reserved bytes 54 to 59": not any(blob[54:60]), "version": version == 2, "track count": 1 <= n <= 32, "backend": backend in (0, 1), "rate": rate == 16384, "bar cells": cells == 32,
        "section order": track_off == 64 and pool_off == 64 + track_len and asset_off == pool_off + pool_len, "alignment": not any(v % 4 for v in sections), "track table size": track_len == 40 * n, "pool size": pool_len < 65536,
    }
    bad = [name for name, ok in told.items() if not ok]
    if asset_off + asset_len != len(blob):
        return [*bad, "file size"]
    table, pool, assets = blob[track_off : track_off + track_len], blob[pool_off : pool_off + pool_len], blob[asset_off:]

    def string(what: str, offset: int) -> list[str]:
        end = pool.find(b"\0", offset)
        if offset >= len(pool) or end < 0:
            return [f"{what}: no string"]
        try:
            pool[offset:end].decode()
        except UnicodeDecodeError:
            return [f"{what}: not UTF-8"]
        return []

    due, used = 0, {title, artist}
    for i in range(min(n, len(table) // 40)):
        t = dict(zip(containers._ALBM_TRACK, struct.unpack_from("<6I2H2BHII", table, 40 * i), strict=True))
        length = t["samples"]
        checks = {
            "reserved bytes": t["reserved"] == 0, "range": length > 0 and t["start_sample"] == due and t["start_sample"] + length <= samples, "asset": t["asset_len"] > 0 and t["asset_off"] + t["asset_len"] <= asset_len,
            "reciprocal": length > 0 and t["recip"] == (32 << 32) // length,
        }
        bad += [f"track {i}: {what}" for what, ok in checks.items() if not ok]
        due = t["start_sample"] + length
        for what in ("title", "artist"):
            used.add(t[f"{what}_off"])
            bad += string(f"track {i} {what}", t[f"{what}_off"])
    if due != samples:
        bad.append("the tracks don't add up")
    bad += string("album title", title) + string("album artist", artist)
    at = 0
    for part in pool.split(b"\0")[:-1]:
        if part and at not in used:
            bad.append(f"pool byte {at}: padding isn't zero")
        at += len(part) + 1
    if pool and pool[-1]:
        bad.append("the pool doesn't end with NUL")
    if containers.fnv32(table, pool) != seal:
        bad.append("structure seal")
    if containers.fnv32(assets) != struct.unpack_from("<I", blob, 60)[0]:
        bad.append("asset seal")
    return bad


def stream_problems(data: bytes) -> list[str]:
    """Cross-check of a whole FLAC stream: declaration, frames, seek points and sizes against each other."""
    try:
        info, start = flac.facts(data)
        points = flac.seek_points(data)
    except _REFUSED as error:
        return [f"metadata: {error}"]
    bad, places, samples, sizes, blocks = [], {}, 0, [], []
    for f in flac.walk_all(data):
        if f["error"]:
            bad.append(f"frame {f['index']}: {f['error']}")
            continue
        head = f["head"]
        if head.number != f["index"]:
            bad.append(f"frame {f['index']}: number {head.number}")
        if (head.rate, head.channels, head.bits) != (info.rate, info.channels, info.bits):
            bad.append(f"frame {f['index']}: another form than declared")
        places[f["offset"] - start] = (samples, head.block)
        samples += head.block
        sizes.append(f["bytes"])
        blocks.append(head.block)
    if info.samples is not None and samples != info.samples:
        bad.append(f"{samples} samples, {info.samples} declared")
    if sizes and (info.least_frame, info.most_frame) not in ((None, None), (min(sizes), max(sizes))):
        bad.append("frame sizes aren't the declared ones")
    if any(b != info.most_block for b in blocks[:-1]) or blocks and blocks[-1] > info.most_block:
        bad.append("block sizes aren't the declared ones")
    for i, (first, offset, n) in enumerate(points):
        if first is not None and places.get(offset) != (first, n):
            bad.append(f"seek point {i}: no frame of its sample and size")
    return bad


def problems(files: DataFrame, kind: str) -> DataFrame:
    """path, problems of files (path, content; for gafp also source): kind is gafp, albm or stream."""
    columns = ["path", "content"] + ["source"] * (kind == "gafp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = {"gafp": gafp_problems, "albm": albm_problems, "stream": stream_problems}[kind]
        for batch in batches:
            yield pd.DataFrame([(r[0], of(*(bytes(x) for x in r[1:]))) for r in batch[columns].itertuples(index=False)], columns=["path", "problems"])

    return files.select(*columns).mapInPandas(run, "path string, problems array<string>")


# pins


def stereo_bytes(left: list[int], right: list[int] | None, low: bool = False) -> bytes:
    """Interleaved 16-bit little-endian samples; mono is the left side alone. A sample out of range refuses the whole, or with low gives its low 16 bits."""
    values = left if right is None else [v for pair in zip(left, right, strict=True) for v in pair]
    if low:
        return struct.pack(f"<{len(values)}H", *[v & 65535 for v in values])
    for v in values:
        if not -32768 <= v <= 32767:
            raise ValueError(f"sample {v} doesn't fit 16 bits")
    return struct.pack(f"<{len(values)}h", *values)


def pcm_digest(left: list[int], right: list[int] | None, before: int = FNV64[0], low: bool = False) -> int:
    """FNV-1a/64 of stereo_bytes, going on from a digest. Nothing is folded where a sample is refused."""
    return fnv_of(stereo_bytes(left, right, low), before, FNV64[1], 64)


def played_digests(left: list[int], right: list[int] | None, before: tuple[int, int] = (FNV64[0], FNV64[0]), low: bool = False) -> tuple[int, int]:
    """FNV-1a/64 of each channel's bytes as they are played, going on from two digests."""
    stereo_bytes(left, right, low)  # refuses before anything is folded
    return tuple(fnv_of(bytes(v >> 8 & 255 for v in x or ()), b, FNV64[1], 64) for x, b in zip((left, right), before, strict=True))


def frame_hash(left: list[int], right: list[int]) -> int:
    """FNV-1a/32 of a frame of 8-bit samples: all of the left, then all of the right."""
    return fnv_of(bytes(v & 255 for v in (*left, *right)), *FNV32, 32)


_PINS = "path string, frame int, samples long, first array<int>, last array<int>, pcm string, played_left string, played_right string, frame_hash long"


def pins(files: DataFrame, low: bool = False) -> DataFrame:
    """Pins of FLAC files: a row per frame, and one of the whole file with a null frame; digests as hex.

    Digests are of 16-bit samples: one out of range refuses the file, or with low counts by its low 16 bits. Ends are whole samples.
    """
    names = [c.split()[0] for c in _PINS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, whole, played, total = [], FNV64[0], (FNV64[0], FNV64[0]), 0
                for f in flac.walk(bytes(content)):
                    left, right = f["slots"][0], f["slots"][1] if len(f["slots"]) > 1 else None
                    ends = [[x[i] for x in f["slots"]] for i in (0, -1)]
                    one = played_digests(left, right, low=low)
                    rows.append((path, f["index"], len(left), *ends, f"{pcm_digest(left, right, low=low):016x}", *(f"{d:016x}" for d in one), frame_hash([v >> 8 for v in left], [v >> 8 for v in right or ()])))
                    whole, played, total = pcm_digest(left, right, whole, low), played_digests(left, right, played, low), total + len(left)
                if rows:
                    rows.append((path, None, total, rows[0][3], rows[-1][4], f"{whole:016x}", *(f"{d:016x}" for d in played), None))
                yield pd.DataFrame(rows, columns=names).astype({"frame": "Int32", "frame_hash": "Int64"})

    return files.select("path", "content").mapInPandas(run, _PINS)


def facts_tables(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """blob, frame and subframe rows of read_frames, each with the keys of the one above."""
    good = frames.where("error is null")
    blob = good.groupBy("path").agg(F.count(F.lit(1)).alias("frames"), F.sum("block").alias("samples"), F.max("block").alias("block"), F.max("rate").alias("rate"), F.max("channels").alias("channels"), F.max(_order()).alias("max_order"), F.sum("bytes").alias("bytes"))
    frame = good.select("path", "frame", "number", "offset", "bytes", "block", "rate", "channels", "layout", "bits", "header_bytes")
    subframe = good.select("path", "frame", F.explode("subframes").alias("s")).select("path", "frame", "s.*")
    return blob, frame, subframe


def _order() -> Column:
    return F.array_max(F.transform("subframes", lambda s: F.when(s["kind"] == "fixed", s["order"]).otherwise(0)))


def slot_census(subframes: DataFrame) -> DataFrame:
    """slot, kind, order, n of facts_tables' subframes, by file."""
    return subframes.groupBy("path", "slot", "kind", "order").agg(F.count(F.lit(1)).alias("n"))


# profiles

#: What the product's profile admits.
PROFILE = {"rates": (16384,), "blocks": (2048,), "bits": (16,), "max_order": 0, "parameter": 10, "budget_percent": 74.0}


def profile_faults(profile: dict) -> list[str]:
    """Why a profile can't be encoded for, before anything is: empty or impossible demands."""
    tests = {
        "rates": bool(profile["rates"]) and all(16_777_216 % r == 0 for r in profile["rates"]), "blocks": bool(profile["blocks"]) and all(16 <= b <= 32768 for b in profile["blocks"]),
        "bits": bool(profile["bits"]) and set(profile["bits"]) <= {8, 16}, "max_order": 0 <= profile["max_order"] <= 4, "parameter": 0 <= profile["parameter"] <= 14, "budget_percent": 0 < profile["budget_percent"] <= 100,
    }
    return [name for name, ok in tests.items() if not ok]


def profile_verdict(blobs: DataFrame, profile: dict) -> DataFrame:
    """path, reasons of facts_tables' blobs against a profile; missing facts fail."""
    if faults := profile_faults(profile):
        raise ValueError(f"a profile that can't be met: {faults}")
    return blobs.select(
        "path",
        reasons(rate=F.col("rate").isin(list(profile["rates"])), block=F.col("block").isin(list(profile["blocks"])), order=F.col("max_order") <= profile["max_order"], channels=F.col("channels").isin(1, 2)).alias("reasons"),
    )


def measured_faults(measured: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """The rows of (id, cycles, budget, percent, block, rate) that contradict themselves: percent by more than the tolerance, or the budget of another block."""
    derived = 100 * F.col("cycles") / F.col("budget")
    period = F.floor(F.col("block").cast("long") * 16_777_216 / F.col("rate"))
    return measured.select("id", reasons(percent=F.abs(derived - F.col("percent")) <= tolerance * derived, budget=F.col("budget") == period).alias("reasons")).where("size(reasons) > 0")


def sample_agreement(*sources: DataFrame) -> DataFrame:
    """path, counts of sources (path, samples) that don't all have the path, or differ."""
    both = None
    for i, s in enumerate(sources):
        own = s.select("path", F.col("samples").alias(f"__s{i}"))
        both = own if both is None else both.join(own, "path", "full")
    counts = F.array(*[F.col(f"__s{i}").cast("long") for i in range(len(sources))])
    return both.select("path", counts.alias("counts")).where(F.exists("counts", lambda c: c.isNull()) | (F.size(F.array_distinct("counts")) > 1))
