"""Ogg pages and Opus packets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.digest import crc_of


def packet_code(toc: Column) -> list[Column]:
    """config, mode, bandwidth, ms, frames_code of a packet's first byte."""
    toc = toc.cast("long")
    celt, hybrid = toc >= 128, toc.bitwiseAND(F.lit(96).cast("long")) == 96

    def pick(values, at, kind):
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at.cast("int"))

    def low(shift, mask):
        return F.shiftright(toc, shift).bitwiseAND(F.lit(mask).cast("long"))

    return [
        F.shiftright(toc, 3).alias("config"),
        F.when(celt, "CELT-only").when(hybrid, "Hybrid").otherwise("SILK-only").alias("mode"),
        F.when(celt, pick(("NB", "WB", "SWB", "FB"), low(5, 3), "string")).when(hybrid, pick(("SWB", "FB"), low(4, 1), "string")).otherwise(pick(("NB", "MB", "WB"), F.shiftright(toc, 5), "string")).alias("bandwidth"),
        F.when(celt, pick((2.5, 5, 10, 20), low(3, 3), "double")).when(hybrid, pick((10, 20), low(3, 1), "double")).otherwise(pick((10, 20, 40, 60), low(3, 3), "double")).alias("ms"),
        toc.bitwiseAND(F.lit(3).cast("long")).alias("frames_code"),
    ]


def pages(data: bytes) -> Iterator[dict]:
    """The pages of one stream, validated: capture pattern, length, CRC and sequence. Raises ValueError."""
    at, sequence = 0, None
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise ValueError(f"no page at {at}")
        flags, granule, serial, number, crc, n = struct.unpack_from("<BqIIIB", data, at + 5)
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) != n or end > len(data):
            raise ValueError(f"the page at {at} is cut off")
        if crc_of("ogg", data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"the page at {at} has another CRC")
        if sequence is not None and number != sequence + 1:
            raise ValueError(f"page {number} follows page {sequence}")
        sequence = number
        yield {"page": number, "offset": at, "flags": flags, "granule": granule, "serial": serial, "lacing": lacing, "body": data[body:end]}
        at = end


def packets(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(first page, packet): segments are joined across pages until one is shorter than 255."""
    held, first = b"", None
    for page in pages(data):
        at = 0
        if not page["flags"] & 1 and held:
            raise ValueError(f"page {page['page']} doesn't continue an open packet")
        for size in page["lacing"]:
            first = page["page"] if first is None else first
            held += page["body"][at : at + size]
            at += size
            if size < 255:
                yield first, held
                held, first = b"", None
    if held:
        raise ValueError("the last packet is open")


def build_page(number: int, body: bytes, lacing: bytes, flags: int = 0, granule: int = 0, serial: int = 1) -> bytes:
    head = b"OggS" + struct.pack("<BBqIII", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    crc = crc_of("ogg", head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def opus_head(packet: bytes) -> dict:
    if packet[:8] != b"OpusHead" or len(packet) < 19:
        raise ValueError("no OpusHead")
    version, channels, pre_skip, rate, gain, family = struct.unpack_from("<BBHIhB", packet, 8)
    return {"version": version, "channels": channels, "pre_skip": pre_skip, "rate": rate, "gain": gain, "family": family}


def read_packets(files: DataFrame, strict: bool = True) -> DataFrame:
    """files (path, content) -> path, packet, page, data, error. Not strict: a bad file is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, error = [], None
                try:
                    rows = [(path, i, page, data, None) for i, (page, data) in enumerate(packets(bytes(content)))]
                except ValueError as e:
                    if strict:
                        raise
                    error = str(e)
                yield pd.DataFrame(rows if error is None else [(path, None, None, None, error)], columns=["path", "packet", "page", "data", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, packet long, page long, data binary, error string")
