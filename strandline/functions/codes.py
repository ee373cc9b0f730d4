"""Codes of a FLAC frame header, as plain tables and as column expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: sample rates, sample sizes and channel layouts by code.
RATE_CODES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
SIZE_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LAYOUTS = {8: "left_side", 9: "side_right", 10: "mid_side"}


def block_of(code: int) -> int | None:
    """Block size of a code; None for the codes whose size follows in the header, and for the reserved one."""
    return 192 if code == 1 else 144 << code if 2 <= code <= 5 else 1 << code if code >= 8 else None


BLOCK_CODES = {code: block_of(code) for code in range(16) if block_of(code) is not None}


def _by_code(code: Column, table: dict[int, object], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for key, value in table.items():
        out = F.when(code == key, F.lit(value).cast(kind)).otherwise(out)
    return out


def rate(code: Column, stream_rate: Column) -> Column:
    """The rate of a header code: 0 stands for the stream's own, 12 and up for a tail in the header (null)."""
    return F.when(code == 0, stream_rate).otherwise(_by_code(code, RATE_CODES, "long"))


def block_size(code: Column) -> Column:
    return _by_code(code, BLOCK_CODES, "long")


def layout(code: Column) -> Column:
    return F.when(code < 8, "independent").otherwise(_by_code(code, LAYOUTS, "string"))


def sample_bits(code: Column, stream_bits: Column) -> Column:
    """0 stands for the stream's own; 3 is reserved."""
    return F.when(code == 0, stream_bits).otherwise(_by_code(code, SIZE_CODES, "long"))
