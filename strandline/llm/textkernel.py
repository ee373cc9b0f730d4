"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

A word is a run of bytes other than space and 0x09 to 0x0D, which no multi-byte sequence contains.
Rows are worked on in slices of about ``SLICE`` bytes and ``ROWS`` rows at most, so that the temporary
arrays stay small whatever the batch size is; one long text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE, ROWS = 1 << 18, 2048

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 64, 256, np.uint64, endpoint=False)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors of the words of a shingle.
_FACTOR = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Rows of a slice: bytes and the offsets of the rows in them. Nulls are empty."""

    def __init__(self, column: pa.Array):
        self.null = np.asarray(column.is_null())
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(column)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batch: pa.RecordBatch, text_at: int = 1) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in parts of about SLICE bytes of text and ROWS rows at most."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0), np.int64)
    part = np.cumsum(sizes) // SLICE + np.arange(len(sizes)) // ROWS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            own = batch.slice(a, b - a)
            yield own, Texts(own.column(text_at))


def runs(texts: Texts, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes for which inside holds; runs end with their row."""
    if not len(texts.data):
        return (np.zeros(0, np.int64),) * 3
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    first = texts.offsets[:-1]
    before[first[first < len(before)]] = False
    last = texts.offsets[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(texts.offsets, starts, "right") - 1


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(texts, ~SPACE[texts.data])


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes (with A-Z as a-z if lower)."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    begins = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(begins, sizes)
    powers = np.empty(int(sizes.max()) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = _STEP
    np.multiply.accumulate(powers, out=powers)
    value = (_BYTE_LOWER if lower else _BYTE)[data[at + np.repeat(starts, sizes)]] * powers[at]
    return mix(np.add.reduceat(value, begins) + sizes.astype(np.uint64))


def shingles(texts: Texts, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each window of k words; a row of fewer words, but not none, is one window."""
    starts, ends, row = words(texts)
    h = hashes(texts.data, starts, ends, lower)
    n_words = np.bincount(row, minlength=texts.n)
    out = []
    if len(h) >= k:
        whole = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
        value = np.zeros(len(whole), np.uint64)
        for j in range(k):
            value += h[whole + j] * _FACTOR[j]
        out.append((row[whole], mix(value + np.uint64(k))))
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.cumsum(n_words) - n_words
        value = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n_words[short] > j
            value[has] += h[first[short[has]] + j] * _FACTOR[j]
        out.append((short, mix(value + n_words[short].astype(np.uint64))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, values = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]
