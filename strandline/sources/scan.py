"""Frame starts without an index: sync shapes, lenient and strict headers, number forms, bit offsets, checksums' reach.

A strict header is a sync code, legal fields and a CRC-8 that agrees; a lenient one has no legal fields.
``precision`` shows per stream what each of them finds, so what a scan can be trusted with is a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandline.functions.digest import crc_of
from strandline.sources import flac
from strandline.sources.bitio import Short


def sync_shapes(data: bytes, start: int = 0) -> np.ndarray:
    """Places from start on where 0xFF is followed by a byte of top bits 11111."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((b[:-1] == 0xFF) & (b[1:] & 0xF8 == 0xF8)) if len(b) > 1 else np.zeros(0, np.int64)
    return at[at >= start]


def octets_of(lead: int) -> int | None:
    """Octets of a coded number by its first one."""
    n = 8 - (lead ^ 0xFF).bit_length()
    return 1 if n == 0 else n if 2 <= n <= 7 else None


def lenient_header(data: bytes, at: int) -> bool:
    """A sync shape, a number of three octets at most, and a CRC-8 right after it that agrees; nothing else is looked at."""
    if at + 8 > len(data) or data[at] != 0xFF or data[at + 1] & 0xF8 != 0xF8:
        return False
    n = octets_of(data[at + 4])
    end = at + 4 + (n or 0)
    return n is not None and n <= 3 and end < len(data) and data[end] == crc_of("crc8", data[at:end])


def strict_header(data: bytes, at: int, info: flac.StreamInfo, shortest: bool = True) -> flac.FrameHeader | None:
    try:
        return flac.frame_header(data, at, info, shortest)
    except (flac.FlacError, Short):
        return None


def header_at_bit(data: bytes, bit: int, info: flac.StreamInfo, window: int = 17) -> flac.FrameHeader | None:
    """The strict header that begins at a bit, with the bytes that it needs moved to that bit."""
    byte, shift = divmod(bit, 8)
    if byte + window > len(data):
        return None
    moved = int.from_bytes(data[byte : byte + window], "big") << shift & (1 << 8 * window) - 1
    return strict_header(moved.to_bytes(window, "big"), 0, info)


def with_number_form(data: bytes, at: int, end: int, octets: int, info: flac.StreamInfo) -> bytes:
    """The stream with the frame's number written in so many octets, and both of its checksums made anew."""
    head = flac.frame_header(data, at, info)
    own = octets_of(data[at + 4])
    lead = (0xFF00 >> octets) & 0xFF | head.number >> (6 * (octets - 1))
    number = bytes([lead]) + bytes(0x80 | head.number >> (6 * i) & 63 for i in reversed(range(octets - 1)))
    first = data[at : at + 4] + number + data[at + 4 + own : at + head.size - 1]
    frame = first + bytes([crc_of("crc8", first)]) + data[at + head.size : end - 2]
    return data[:at] + frame + crc_of("crc16", frame).to_bytes(2, "big") + data[end:]


def checksum_reach(frame: bytes, header_bytes: int) -> tuple[bool, bool]:
    """If the frame's CRC-16 covers header and body, and if it covers the body alone."""
    stored = int.from_bytes(frame[-2:], "big")
    return crc_of("crc16", frame[:-2]) == stored, crc_of("crc16", frame[header_bytes:-2]) == stored


_CANDIDATES = "path string, offset long, lenient boolean, strict boolean, any_form boolean, number long"
_FORMS = "path string, octets int, shortest_refused boolean, any_form boolean, frame_crc boolean, frames int"
_BITS = "path string, shift int, at_bit boolean, at_byte boolean"


def _rows(files: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *r) for r in rows_of(bytes(content))], columns=names).astype(object)

    return files.select("path", "content").mapInPandas(run, schema)


def candidates(files: DataFrame) -> DataFrame:
    """A row for each sync shape of a FLAC file's frames: which header readers accept it, and the strict one's number."""

    def rows(data: bytes):
        info, start = flac.facts(data)
        for at in sync_shapes(data, start).tolist():
            head = strict_header(data, at, info)
            yield at, lenient_header(data, at), head is not None, strict_header(data, at, info, False) is not None, head.number if head else None

    return _rows(files, _CANDIDATES, rows)


def precision(files: DataFrame) -> DataFrame:
    """path, expected, sync, lenient, strict, exact: what each reader finds against the declared frames; exact: strict numbers are 0, 1, 2, ... in order."""

    def rows(data: bytes):
        info, start = flac.facts(data)
        at = sync_shapes(data, start).tolist()
        numbers = [h.number for h in (strict_header(data, i, info) for i in at) if h]
        expected = -(-info.samples // info.most_block) if info.samples else 0
        yield expected, len(at), sum(lenient_header(data, i) for i in at), len(numbers), numbers == list(range(expected))

    return _rows(files, "path string, expected int, sync int, lenient int, strict int, exact boolean", rows)


def number_forms(files: DataFrame, forms: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """The first frame's number in longer forms: refused for its form alone, as both checksums agree with it."""

    def rows(data: bytes):
        info, start = flac.facts(data)
        _, _, _, end = flac.frame(data, start, info)
        for octets in forms:
            changed = with_number_form(data, start, end, octets, info)
            wide = strict_header(changed, start, info, False)
            own = octets_of(data[start + 4])
            grown = end + octets - own
            yield octets, strict_header(changed, start, info) is None, wide is not None and wide.number == 0, bool(wide) and checksum_reach(changed[start:grown], wide.size)[0], len(list(f for f in flac.walk(changed, True) if not f["error"]))

    return _rows(files, _FORMS, rows)


def bit_offsets(files: DataFrame) -> DataFrame:
    """The first frame moved by 0 to 7 bits: found at its bit, and not by a reader of bytes unless it begins one."""

    def rows(data: bytes):
        info, start = flac.facts(data)
        part = data[start : start + 64].ljust(64, b"\0")
        for shift in range(8):
            moved = (int.from_bytes(part, "big") << 8 - shift).to_bytes(65, "big")
            head = header_at_bit(moved, shift, info)
            yield shift, head is not None and head.number == 0, strict_header(moved, 0, info) is not None

    return _rows(files, _BITS, rows)


def checksums(files: DataFrame) -> DataFrame:
    """path, frame, whole, body_alone: what each frame's CRC-16 covers."""

    def rows(data: bytes):
        for f in flac.walk(data):
            yield f["index"], *checksum_reach(data[f["offset"] : f["offset"] + f["bytes"]], f["head"].size)

    return _rows(files, "path string, frame int, whole boolean, body_alone boolean", rows)
