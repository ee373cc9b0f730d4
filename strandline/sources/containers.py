"""Packed containers, read to tables and written from them: GAFP assets, ULA2 and ALBM albums, ART1 images.

Writers assemble one blob from rows that were aggregated and numbered by Spark: a blob has at most 32
tracks or a frame table of 65,535 rows, so what reaches the writer is bounded by the format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from strandline.functions.digest import FNV32, fnv_of


class ContainerError(ValueError):
    pass


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ContainerError(why)


def fnv32(*parts: bytes) -> int:
    return fnv_of(b"".join(parts), *FNV32, 32)


def text_at(pool: bytes, offset: int) -> str:
    """A NUL-terminated string of a pool."""
    end = pool.find(b"\0", offset)
    _need(0 <= offset < len(pool) and end >= 0, f"no string at {offset}")
    return pool[offset:end].decode("utf-8")


def build_pool(strings: list[str], align: int = 4) -> tuple[bytes, list[int]]:
    """Distinct strings in the order of first use, NUL-terminated, padded; and the offset of each one given."""
    seen: dict[str, int] = {}
    pool = b""
    for s in strings:
        if s not in seen:
            seen[s] = len(pool)
            pool += s.encode() + b"\0"
    return pool + b"\0" * (-len(pool) % align), [seen[s] for s in strings]


# GAFP: a 28-byte header, a table of frame offsets, frames


def parse_gafp(blob: bytes) -> dict:
    return parse_gafp_head(blob, len(blob))


def parse_gafp_head(blob: bytes, size: int) -> dict:
    """From the header and the offset table alone, of a file of size bytes."""
    _need(len(blob) >= 28 and blob[:4] == b"GAFP" and blob[4] == 1, "no GAFP version 1")
    channels, bits, order, block, rate, samples, n, start = struct.unpack_from("<BBBHIQHI", blob, 5)
    _need(channels in (1, 2) and bits in (8, 16) and block > 0 and rate > 0 and order <= 4, "a header field is out of range")
    _need(start == 28 + 4 * n and start <= min(len(blob), size), "the table doesn't end where the frames begin")
    offsets = list(struct.unpack_from(f"<{n}I", blob, 28))
    _need(not n or offsets[0] == start and all(a < b for a, b in zip(offsets, offsets[1:], strict=False)) and offsets[-1] < size, "frame offsets out of order")
    return {"channels": channels, "bits": bits, "max_order": order, "block": block, "rate": rate, "samples": samples, "frames": n, "frame_data": start, "offsets": offsets}


def build_gafp(frames: list[bytes], channels: int, bits: int, order: int, block: int, rate: int, samples: int) -> bytes:
    start = 28 + 4 * len(frames)
    head = b"GAFP" + struct.pack("<BBBBHIQHI", 1, channels, bits, order, block, rate, samples, len(frames), start)
    at, table = start, b""
    for f in frames:
        table += struct.pack("<I", at)
        at += len(f)
    blob = head + table + b"".join(frames)
    parse_gafp(blob)
    return blob


def pack_flac(data: bytes) -> bytes:
    """A FLAC stream's frames, copied as they are, in a GAFP container."""
    from strandline.sources import flac

    info, _ = flac.facts(data)
    rows = list(flac.walk(data))
    order = max((s["order"] for r in rows for s in r["subframes"] if s["kind"] == "fixed"), default=0)
    return build_gafp([data[r["offset"] : r["offset"] + r["bytes"]] for r in rows], info.channels, info.bits, order, info.most_block, info.rate, sum(r["head"].block for r in rows))


def decode_gafp(blob: bytes, first: int = 0) -> Iterator[tuple[int, list[list[int]]]]:
    """(frame, samples by channel) from frame first on: the offset table makes every frame an entry."""
    from strandline.sources import flac

    m = parse_gafp(blob)
    info = flac.StreamInfo(16, 65535, None, None, m["rate"], m["channels"], m["bits"], m["samples"], None)
    for i in range(first, m["frames"]):
        head, slots, _, end = flac.frame(blob, m["offsets"][i], info)
        _need(end == (m["offsets"][i + 1] if i + 1 < m["frames"] else len(blob)), f"frame {i} doesn't end where the next begins")
        _need(head.block == m["block"] or i == m["frames"] - 1, f"frame {i} has another block size")
        yield i, slots


# ULA2: header, tracks, code tables, seek entries, strings, stream

_ULA_HEAD = ("magic", "version", "header_bytes", "rate", "hop", "frames", "samples", "tracks", "tracks_off", "tables_off", "tables_bytes", "seek_off", "seeks", "seek_interval", "strings_off", "strings_bytes", "stream_off", "halfwords", "most_cycles", "mean_cycles")
_ULA_TRACK = ("start_sample", "samples", "preroll_frame", "bitpos", "g_prev", "skip", "title_off", "artist_off")


def parse_ula2(blob: bytes) -> dict:
    _need(len(blob) >= 88, "shorter than its header")
    h = dict(zip(_ULA_HEAD, struct.unpack_from("<IHH17I", blob), strict=True))
    _need(h["magic"] == 0x32414C55 and h["version"] == 1 and h["header_bytes"] == 88 and h["rate"] == 32768 and h["hop"] == 512, "no ULA2 version 1")
    _need(1 <= h["tracks"] <= 32 and h["frames"] >= 1 and h["seek_interval"] == 256 and h["seeks"] >= (h["frames"] - 1 >> 8) + 1, "a count is out of range")
    _need(h["tracks_off"] % 4 == 0 and h["seek_off"] % 4 == 0 and h["stream_off"] % 2 == 0 and 4 <= h["halfwords"] <= 0x0FFFFFFF, "a section isn't aligned")
    for off, size in ((h["tracks_off"], 24 * h["tracks"]), (h["tables_off"], h["tables_bytes"]), (h["seek_off"], 8 * h["seeks"]), (h["strings_off"], h["strings_bytes"]), (h["stream_off"], 2 * h["halfwords"])):
        _need(off + size <= len(blob), "a section ends beyond the file")
    strings = blob[h["strings_off"] : h["strings_off"] + h["strings_bytes"]]
    _need(not strings or strings[-1] == 0, "the strings don't end with NUL")
    tracks = []
    for t in range(h["tracks"]):
        row = dict(zip(_ULA_TRACK, struct.unpack_from("<IIIIHHHH", blob, h["tracks_off"] + 24 * t), strict=True))
        _need(row["preroll_frame"] < h["frames"] and row["bitpos"] < 16 * h["halfwords"], f"track {t} begins beyond the stream")
        tracks.append(row | {"title": text_at(strings, row["title_off"]), "artist": text_at(strings, row["artist_off"])})
    seeks = [struct.unpack_from("<IH", blob, h["seek_off"] + 8 * i) for i in range(h["seeks"])]
    _need(all(bit < 16 * h["halfwords"] for bit, _ in seeks), "a seek entry beyond the stream")
    return {"header": h, "tracks": tracks, "seeks": [{"bitpos": b, "g_prev": g} for b, g in seeks], "tables": blob[h["tables_off"] : h["tables_off"] + h["tables_bytes"]], "stream": blob[h["stream_off"] : h["stream_off"] + 2 * h["halfwords"]]}


def build_ula2(tracks: list[dict], positions: list[tuple[int, int]], tables: bytes, stream: bytes, samples: int, most_cycles: int = 0, mean_cycles: int = 0) -> bytes:
    """positions: (bit position, g before) of every frame. tracks: start_sample, samples, preroll_frame, skip, title, artist."""
    pool, offsets = build_pool([s for t in tracks for s in (t["title"], t["artist"])], 2)
    tables += b"\0" * (-len(tables) % 4)
    seeks = (len(positions) - 1 >> 8) + 1
    tables_off = 88 + 24 * len(tracks)
    seek_off = tables_off + len(tables)
    strings_off = seek_off + 8 * seeks
    stream_off = strings_off + len(pool)
    head = struct.pack("<IHH17I", 0x32414C55, 1, 88, 32768, 512, len(positions), samples, len(tracks), 88, tables_off, len(tables), seek_off, seeks, 256, strings_off, len(pool), stream_off, len(stream) // 2, most_cycles, mean_cycles)
    rows = b"".join(struct.pack("<IIIIHHHH", t["start_sample"], t["samples"], t["preroll_frame"], *positions[t["preroll_frame"]], t["skip"], offsets[2 * i], offsets[2 * i + 1]) for i, t in enumerate(tracks))
    entries = b"".join(struct.pack("<IHH", *positions[256 * i], 0) for i in range(seeks))
    blob = head.ljust(88, b"\0") + rows + tables + entries + pool + stream
    parse_ula2(blob)
    return blob


def with_cycles(blob: bytes, most: int, mean: int) -> bytes:
    """An album with its cost estimates written into the header, which come to be known last."""
    parse_ula2(blob)
    at = 68  # after the fields before them
    return blob[:at] + struct.pack("<II", most, mean) + blob[at + 8 :]


# ALBM: header, tracks, string pool, assets, sealed by two FNV-1a/32

_ALBM_TRACK = ("start_sample", "samples", "recip", "asset_off", "asset_len", "frames", "title_off", "artist_off", "backend", "max_order", "ceiling", "fnv", "reserved")


def parse_albm(blob: bytes) -> dict:
    _need(len(blob) >= 64 and blob[:4] == b"ALBM", "no ALBM")
    version, n, backend, zero, rate, cells, samples, track_off, track_len, pool_off, pool_len, asset_off, asset_len, seal, title, artist, year = struct.unpack_from("<4B10I3H", blob, 4)
    assets_seal = struct.unpack_from("<I", blob, 60)[0]
    _need(zero == 0 and not any(blob[54:60]), "a reserved byte is set")
    _need(version == 2 and 1 <= n <= 32 and rate == 16384 and cells == 32, "a version, count, rate or bar that isn't this format's")
    _need(track_off == 64 and pool_off == 64 + track_len and asset_off == pool_off + pool_len and track_len == 40 * n and len(blob) == asset_off + asset_len and pool_len % 4 == 0, "sections out of order")
    table, pool, assets = blob[64:pool_off], blob[pool_off:asset_off], blob[asset_off:]
    tracks, due = [], 0
    for i in range(n):
        t = dict(zip(_ALBM_TRACK, struct.unpack_from("<6I2H2BHII", table, 40 * i), strict=True))
        _need(t["reserved"] == 0, f"track {i}: a reserved byte is set")
        _need(t["start_sample"] == due and t["samples"] > 0, f"track {i} doesn't begin where the one before ends")
        _need(t["asset_len"] > 0 and t["asset_off"] + t["asset_len"] <= asset_len, f"track {i}: an asset out of bounds")
        _need(t["recip"] == (32 << 32) // t["samples"], f"track {i}: a reciprocal that isn't exact")
        due += t["samples"]
        tracks.append(t | {"title": text_at(pool, t["title_off"]), "artist": text_at(pool, t["artist_off"])})
    _need(due == samples, "the tracks don't add up to the album")
    _need(fnv32(table, pool) == seal, "the structure's seal is broken")
    return {"backend": backend, "samples": samples, "title": text_at(pool, title), "artist": text_at(pool, artist), "year": year, "tracks": tracks, "assets": assets, "assets_ok": fnv32(assets) == assets_seal}


def build_albm(title: str, artist: str, year: int, tracks: list[dict], backend: int = 1) -> bytes:
    """tracks: samples, title, artist, asset (bytes; equal assets are stored once), frames, max_order, ceiling."""
    pool, offsets = build_pool([title, artist] + [s for t in tracks for s in (t["title"], t["artist"])])
    assets, places, table, start = b"", {}, b"", 0
    for i, t in enumerate(tracks):
        if t["asset"] not in places:
            places[t["asset"]] = len(assets)
            assets += t["asset"]
        table += struct.pack(
            "<6I2H2BHII", start, t["samples"], (32 << 32) // t["samples"], places[t["asset"]], len(t["asset"]), t.get("frames", 0), offsets[2 * i + 2], offsets[2 * i + 3], backend, t.get("max_order", 0), t.get("ceiling", 0), fnv32(t["asset"]), 0
        )
        start += t["samples"]
    pool_off = 64 + len(table)
    head = b"ALBM" + struct.pack("<4B10I3H", 2, len(tracks), backend, 0, 16384, 32, start, 64, len(table), pool_off, len(pool), pool_off + len(pool), len(assets), fnv32(table, pool), offsets[0], offsets[1], year)
    blob = head + bytes(6) + struct.pack("<I", fnv32(assets)) + table + pool + assets
    parse_albm(blob)
    return blob


# ART1: header, palettes, 8 x 8 tiles of 4 bits, map


def parse_art1(blob: bytes) -> dict:
    _need(len(blob) >= 64 and blob[:4] == b"ART1", "no ART1")
    version, width, height, tile_bytes, banks, cols, rows, dither, source, z1, z2, seal, z3, z4, z5 = struct.unpack_from("<15I", blob, 4)
    _need(not any((z1, z2, z3, z4, z5)), "a reserved word is set")
    _need(version == 1 and tile_bytes == 32 and width % 8 == 0 and height % 8 == 0 and width > 0 and height > 0 and 1 <= banks <= 4 and cols == width // 8 and rows == height // 8, "a header field is out of range")
    n = cols * rows
    palette_end, tile_end = 64 + 32 * banks, 64 + 32 * banks + 32 * n
    _need(len(blob) == -(-(tile_end + 2 * n) // 4) * 4, "a length that isn't the header's")
    cells = struct.unpack_from(f"<{n}H", blob, tile_end)
    _need(all(c & 0x3FF < n and c >> 12 < banks for c in cells), "a map entry names no tile or palette")
    _need(fnv32(blob[64 : tile_end + 2 * n]) == seal, "the seal is broken")
    palette = struct.unpack_from(f"<{16 * banks}H", blob, 64)
    pixels = []
    for y in range(height):
        row = []
        for x in range(width):
            cell = cells[(y // 8) * cols + x // 8]
            byte = blob[palette_end + 32 * (cell & 0x3FF) + 4 * (y % 8) + x % 8 // 2]
            row.append(palette[16 * (cell >> 12) + (byte >> 4 if x % 2 else byte & 15)])
        pixels.append(row)
    return {"width": width, "height": height, "dither": dither, "source": source, "pixels": pixels}


def build_art1(pixels: list[list[int]], dither: int = 0) -> bytes:
    """pixels: rows of 15-bit colours, at most 16 distinct ones, which are kept exactly."""
    height, width = len(pixels), len(pixels[0])
    colours = sorted({c for row in pixels for c in row})
    _need(len(colours) <= 16, f"{len(colours)} colours don't fit a palette of 16")
    at = {c: i for i, c in enumerate(colours)}
    palette = struct.pack("<16H", *colours, *[0] * (16 - len(colours)))
    tiles = b"".join(bytes(at[pixels[ty + y][tx + x]] | at[pixels[ty + y][tx + x + 1]] << 4 for y in range(8) for x in range(0, 8, 2)) for ty in range(0, height, 8) for tx in range(0, width, 8))
    n = (width // 8) * (height // 8)
    cells = struct.pack(f"<{n}H", *range(n))
    source = fnv32(b"".join(struct.pack("<H", c) for row in pixels for c in row))
    head = b"ART1" + struct.pack("<15I", 1, width, height, 32, 1, width // 8, height // 8, dither, source, 0, 0, fnv32(palette, tiles, cells), 0, 0, 0)
    body = head + palette + tiles + cells
    return body + b"\0" * (-len(body) % 4)


_PARSERS = {"gafp": parse_gafp, "ula2": parse_ula2, "albm": parse_albm, "art1": parse_art1}
_ROWS = {
    "gafp": ("path string, frame int, offset long, bytes long, error string", lambda m, size: [(i, o, (m["offsets"] + [size])[i + 1] - o) for i, o in enumerate(m["offsets"])]),
    "ula2": ("path string, track int, start_sample long, samples long, preroll_frame long, bitpos long, title string, artist string, error string", lambda m, _: [(i, t["start_sample"], t["samples"], t["preroll_frame"], t["bitpos"], t["title"], t["artist"]) for i, t in enumerate(m["tracks"])]),
    "albm": ("path string, track int, start_sample long, samples long, asset_off long, asset_len long, title string, artist string, error string", lambda m, _: [(i, t["start_sample"], t["samples"], t["asset_off"], t["asset_len"], t["title"], t["artist"]) for i, t in enumerate(m["tracks"])]),
    "art1": ("path string, y int, x int, colour int, error string", lambda m, _: [(y, x, c) for y, row in enumerate(m["pixels"]) for x, c in enumerate(row)]),
}


def read(files: DataFrame, kind: str, strict: bool = True) -> DataFrame:
    """files (path, content) -> the rows of a container: frames, tracks or pixels. Not strict: a refusal is a row with its reason."""
    schema, rows_of = _ROWS[kind]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    blob = bytes(content)
                    rows = [(path, *r, None) for r in rows_of(_PARSERS[kind](blob), len(blob))]
                except (ContainerError, struct.error, UnicodeDecodeError) as error:
                    if strict:
                        raise ContainerError(f"{path}: {error}") from error
                    rows = [(path, *[None] * (len(names) - 2), str(error))]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def packed_pcm(files: DataFrame, first: int = 0) -> DataFrame:
    """path, i, left, right of GAFP files from frame first on. Each frame is entered by its offset, so frames spread over tasks."""

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                blob = bytes(content)
                m = parse_gafp(blob)
                ends = [*m["offsets"][1:], len(blob)]
                rows = [(path, i, i * m["block"], m["block"], m["rate"], m["channels"], m["bits"], i + 1 == m["frames"], blob[a:b]) for i, (a, b) in enumerate(zip(m["offsets"], ends, strict=True)) if i >= first]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SLICE.split(", ")])

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from strandline.sources import flac

        for batch in batches:
            for r in batch.itertuples(index=False):
                info = flac.StreamInfo(16, 65535, None, None, r.rate, r.channels, r.bits, None, None)
                head, slots, _, end = flac.frame(bytes(r.part), 0, info)
                _need(end == len(r.part), f"frame {r.frame} doesn't end where the next begins")
                _need(head.block == r.block or r.last, f"frame {r.frame} has another block size")
                yield pd.DataFrame({"path": r.path, "i": range(r.start, r.start + head.block), "left": slots[0], "right": slots[-1]})

    parts = files.select("path", "content").mapInPandas(slices, _SLICE).repartition("path", "frame")
    return parts.mapInPandas(samples, "path string, i long, left int, right int")


_SLICE = "path string, frame int, start long, block int, rate int, channels int, bits int, last boolean, part binary"
