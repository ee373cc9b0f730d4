"""Digests that Spark has no built-in for: CRC-8, CRC-16, the Ogg CRC-32 and FNV-1a.

Two forms of each: a higher-order function for short values, which stays in the JVM, and an Arrow
function for long ones, which folds whole columns byte position by byte position in NumPy.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset bases and primes. The 64-bit basis in use here isn't the published one.
FNV32 = (0x811C9DC5, 0x01000193)
FNV64 = (0xCBF43CE95DE684B7, 0x100000001B3)
FNV64_PUBLISHED = (0xCBF29CE484222325, 0x100000001B3)
#: Width, polynomial; all start at 0, most significant bit first, without a final inversion.
CRCS = {"crc8": (8, 0x07), "crc16": (16, 0x8005), "ogg": (32, 0x04C11DB7)}


@cache
def crc_table(name: str) -> tuple[int, ...]:
    width, poly = CRCS[name]
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for i in range(256):
        x = i << (width - 8)
        for _ in range(8):
            x = ((x << 1) ^ poly) & mask if x & top else x << 1
        out.append(x)
    return tuple(out)


def crc_of(name: str, data: bytes) -> int:
    width, table, x = CRCS[name][0], crc_table(name), 0
    for b in data:
        x = ((x << 8) & ((1 << width) - 1)) ^ table[((x >> (width - 8)) ^ b) & 255]
    return x


def fnv_of(data: bytes, basis: int, prime: int, bits: int) -> int:
    for b in data:
        basis = ((basis ^ b) * prime) & ((1 << bits) - 1)
    return basis


def _bytes(text: Column) -> Column:
    h = F.hex(F.encode(text, "UTF-8"))
    return F.when(F.length(h) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("long"))
    )


def crc_short(name: str, text: Column) -> Column:
    """The CRC of a short string's UTF-8, as LONG."""
    width = CRCS[name][0]
    table = F.array(*[F.lit(x).cast("long") for x in crc_table(name)])
    mask = F.lit((1 << width) - 1).cast("long")

    def step(x: Column, b: Column) -> Column:
        at = F.shiftright(x, width - 8).bitwiseXOR(b).bitwiseAND(F.lit(255).cast("long"))
        return F.shiftleft(x, 8).bitwiseAND(mask).bitwiseXOR(F.get(table, at.cast("int")))

    return F.aggregate(_bytes(text), F.lit(0).cast("long"), step)


def fnv32_short(text: Column, basis: int = FNV32[0]) -> Column:
    mask = F.lit(0xFFFFFFFF).cast("long")
    return F.aggregate(_bytes(text), F.lit(basis).cast("long"), lambda x, b: (x.bitwiseXOR(b) * FNV32[1]).bitwiseAND(mask))


def fnv64_short(text: Column, basis: int = FNV64[0]) -> Column:
    """As 16 hex digits: two 32-bit halves, since LONG is signed and checked."""
    low32 = F.lit(0xFFFFFFFF).cast("long")

    def step(x: Column, b: Column) -> Column:
        hi, lo = x["hi"], x["lo"].bitwiseXOR(b)
        # prime = 2**40 + 0x1B3
        small = lo * 0x1B3
        up = F.shiftright(small, 32) + hi * 0x1B3 + F.shiftleft(lo, 8)
        return F.struct(up.bitwiseAND(low32).alias("hi"), small.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(basis >> 32).cast("long").alias("hi"), F.lit(basis & 0xFFFFFFFF).cast("long").alias("lo"))
    folded = F.aggregate(_bytes(text), start, step)
    return F.lower(F.concat(F.lpad(F.hex(folded["hi"]), 8, "0"), F.lpad(F.hex(folded["lo"]), 8, "0")))


#: With fewer rows than this left, the rest of their bytes is folded row by row: a step over arrays costs more than so many plain ones.
_FEW = 48


def _raws(values: pd.Series) -> list[bytes]:
    return [b"" if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in values]


def _columns(raw: list[bytes]):
    """Byte positions of all values while at least _FEW are that long: (rows, their bytes). Ends with (rows, None): what is left of them."""
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    live, i = len(raw), 0
    while True:
        while live and sizes[order[live - 1]] <= i:
            live -= 1
        if live < _FEW:
            yield order[:live], None, i
            return
        rows = order[:live]
        yield rows, data[begins[rows] + i], i
        i += 1


class _Fold:
    """A digest over columns of bytes, and over the rest of one row."""

    def __init__(self, name: str, basis: int | None = None):
        self.name = name
        if name in CRCS:
            self.width, self.table, self.start = CRCS[name][0], np.array(crc_table(name), np.uint64), 0
        else:
            self.width, (start, self.prime) = (64, FNV64) if name == "fnv64" else (32, FNV32)
            self.start = start if basis is None else basis
        self.mask = (1 << self.width) - 1

    def step(self, x: np.ndarray, byte: np.ndarray) -> np.ndarray:
        if self.name in CRCS:
            return ((x << np.uint64(8)) & np.uint64(self.mask)) ^ self.table[((x >> np.uint64(self.width - 8)) ^ byte) & np.uint64(255)]
        new = (x ^ byte.astype(np.uint64)) * np.uint64(self.prime)
        return new if self.width == 64 else new & np.uint64(self.mask)

    def rest(self, x: int, data: bytes) -> int:
        mask = self.mask
        if self.name in CRCS:
            table, down = crc_table(self.name), self.width - 8
            for b in data:
                x = (x << 8 & mask) ^ table[(x >> down ^ b) & 255]
        else:
            prime = self.prime
            for b in data:
                x = (x ^ b) * prime & mask
        return x


def _folded(raw: list[bytes], folds: list[_Fold]) -> list[np.ndarray]:
    """The folds of every value, one pass over the byte positions for all of them."""
    out = [np.full(len(raw), f.start, np.uint64) for f in folds]
    for rows, byte, at in _columns(raw):
        if byte is not None:
            for x, f in zip(out, folds, strict=True):
                x[rows] = f.step(x[rows], byte)
            continue
        for r in rows.tolist():
            for x, f in zip(out, folds, strict=True):
                x[r] = f.rest(int(x[r]), raw[r][at:])
    return out


def crc_udf(name: str):
    """Arrow form of crc_short, for strings and binaries of any length."""

    @F.pandas_udf("long")
    def crc(values: pd.Series) -> pd.Series:
        return pd.Series(_folded(_raws(values), [_Fold(name)])[0].astype(np.int64))

    return crc


def fnv_udf(bits: int = 64, basis: int | None = None):
    """Arrow form of FNV-1a: hex digits of 64 bits, LONG of 32 bits."""
    if bits == 32:

        @F.pandas_udf("long")
        def fnv32(values: pd.Series) -> pd.Series:
            return pd.Series(_folded(_raws(values), [_Fold("fnv32", basis)])[0].astype(np.int64))

        return fnv32

    @F.pandas_udf("string")
    def fnv64(values: pd.Series) -> pd.Series:
        return pd.Series([f"{v:016x}" for v in _folded(_raws(values), [_Fold("fnv64", basis)])[0].tolist()])

    return fnv64


def digests(text: Column) -> Column:
    """A struct of crc8, crc16, ogg, fnv32 and fnv64 of texts of any length: one Arrow function and one pass over the bytes for all."""

    @F.pandas_udf("struct<crc8:long,crc16:long,ogg:long,fnv32:long,fnv64:string>")
    def run(values: pd.Series) -> pd.DataFrame:
        found = _folded(_raws(values), [_Fold(n) for n in (*CRCS, "fnv32", "fnv64")])
        out = {n: x.astype(np.int64) for n, x in zip((*CRCS, "fnv32"), found, strict=False)}
        return pd.DataFrame(out | {"fnv64": [f"{v:016x}" for v in found[-1].tolist()]})

    return run(text)
