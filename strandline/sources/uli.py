"""ULA2 frame symbols: code tables, the frame reader and the frame writer.

The stream is read most significant bit first within little-endian 16-bit words. A frame is the
difference of its step, a mid/side bit, and for each of two channels a class symbol per band, coded in
the context of the class before, with the band's magnitudes as pair or quad symbols and their tails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.stats import code_lengths
from strandline.sources.bitio import Bits, BitWriter, Short
from strandline.sources.containers import ContainerError, parse_ula2

#: Fixed values of the format.
BANDS, WIDTH, CODED, STEPS = 32, 16, 500, 192
ZERO, QUAD, PAIR = 0, 1, 2
#: Bits of a word that a code table is asked for at once.
LOOK = 10
#: Fixed values of the default tables: by class its type, raw bits and mean magnitude.
TYPES = (ZERO, QUAD, QUAD, PAIR, PAIR, PAIR, PAIR, PAIR, PAIR, PAIR, PAIR, PAIR, PAIR, PAIR)
MEANS = (0, 0.12, 0.45, 0.8, 1.3, 2, 3, 4.5, 6.5, 10, 20, 40, 80, 160)
RAW = (0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5)


def canonical(lengths: list[int]) -> list[int]:
    """Codes in the order of (length, symbol); 0 for symbols without one."""
    codes, code, last = [0] * len(lengths), 0, 0
    for length, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        codes[s], last = code, length
        code += 1
    return codes


@dataclass
class Book:
    lengths: list[int]
    codes: list[int] = field(default_factory=list)
    by_code: dict[tuple[int, int], int] = field(default_factory=dict)
    short: list[tuple[int, int]] = field(default_factory=list)  # symbol and length of the word that the next LOOK bits begin with
    share: float = 0.0  # of all words that the code's words take; 1 if it is complete

    def __post_init__(self):
        self.codes = canonical(self.lengths)
        self.by_code = {(n, c): s for s, (n, c) in enumerate(zip(self.lengths, self.codes, strict=True)) if n}
        self.share = sum(2.0**-n for n in self.lengths if n)
        if self.share > 1 + 1e-9:
            raise ContainerError("a code with more words than fit")
        self.short = [(0, 0)] * (1 << LOOK)
        for (n, c), s in self.by_code.items():
            if n <= LOOK:
                self.short[c << LOOK - n : (c + 1) << LOOK - n] = [(s, n)] * (1 << LOOK - n)

    def read(self, b: Bits) -> int:
        """By a table of the next bits; longer words bit by bit."""
        s, n = self.short[b.peek(LOOK)]
        if n and b.at + n <= b.end:
            b.at += n
            return s
        code = 0
        for n in range(1, 17):
            code = code << 1 | b.read(1)
            if (n, code) in self.by_code:
                return self.by_code[n, code]
        raise ContainerError("no such code word")

    def write(self, w: BitWriter, s: int) -> None:
        if not self.lengths[s]:
            raise ContainerError(f"symbol {s} has no code word")
        w.put(self.codes[s], self.lengths[s])


@lru_cache(512)
def book(lengths: bytes) -> Book:
    """The book of these lengths, made once: books are replaced in tables, never changed."""
    return Book(list(lengths))


@cache
def _default_books() -> tuple[Book, list[Book | None]]:
    """The context and the books of the default tables, from geometric models of the magnitudes."""
    books: list[Book | None] = []
    for t, mean, raw in zip(TYPES, MEANS, RAW, strict=True):
        share = mean / (1 + mean)
        p = [(1 - share) * share**i for i in range(5001)]
        if t == QUAD:
            d = (p[0], p[1], 1 - p[0] - p[1])
            books.append(Book(code_lengths([d[s // 27] * d[s // 9 % 3] * d[s // 3 % 3] * d[s % 3] * 1e6 for s in range(81)], floor=0.5)))
        elif t == PAIR:
            head = [sum(p[j << raw : (j + 1) << raw]) for j in range(15)]
            head.append(max(1 - sum(head), 1e-9))
            books.append(Book(code_lengths([head[s >> 4] * head[s & 15] * 1e6 for s in range(256)], floor=0.5)))
        else:
            books.append(None)
    return Book(code_lengths([1.0] * (len(TYPES) + 1), floor=0.5)), books


@dataclass
class Tables:
    """Classes' types, raw bits and escape orders, dequantiser offsets, class books by context, symbol books by class."""

    types: list[int]
    raw: list[int]
    escape: list[int]
    offsets: list[list[int]]
    contexts: list[Book]
    books: list[Book | None]

    @classmethod
    def parse(cls, blob: bytes) -> Tables:
        k = blob[0] if blob else 0
        if not 2 <= k <= 16 or len(blob) < 1 + 3 * k + (k + 1) ** 2 + 353 * k:
            raise ContainerError("code tables of a wrong size")
        at = 1
        types, raw, escape = (list(blob[at + i * k : at + (i + 1) * k]) for i in range(3))
        if max(raw) > 16 or max(escape) > 24:
            raise ContainerError("raw bits or an escape order out of range")
        at += 3 * k
        contexts = [book(bytes(blob[at + i * (k + 1) : at + (i + 1) * (k + 1)])) for i in range(k + 1)]
        at += (k + 1) ** 2
        quads, pairs = at, at + 81 * k
        at = pairs + 256 * k
        books: list[Book | None] = [book(bytes(blob[quads + 81 * c : quads + 81 * c + 81])) if t == QUAD else book(bytes(blob[pairs + 256 * c : pairs + 256 * c + 256])) if t == PAIR else None for c, t in enumerate(types)]
        offsets = [[v - 256 if v > 127 else v for v in blob[at + 16 * c : at + 16 * c + 16]] for c in range(k)]
        return cls(types, raw, escape, offsets, contexts, books)

    def blob(self) -> bytes:
        k = len(self.types)
        out = bytes([k, *self.types, *self.raw, *self.escape]) + b"".join(bytes(b.lengths) for b in self.contexts)
        for shape, width in ((QUAD, 81), (PAIR, 256)):
            out += b"".join(bytes(b.lengths) if b and t == shape else bytes(width) for t, b in zip(self.types, self.books, strict=True))
        out += b"".join(bytes(v & 255 for v in row) for row in self.offsets)
        return out + b"\0" * (-len(out) % 4)

    @classmethod
    def default(cls) -> Tables:
        """From geometric models of the magnitudes, one mean a class; every context alike."""
        k = len(TYPES)
        context, books = _default_books()
        return cls(list(TYPES), list(RAW), [0] * k, [[0] + [3] * 15 for _ in range(k)], [context] * (k + 1), list(books))

    def violations(self) -> list[tuple[int, str, int]]:
        """(class, what, value) of what a reader's premises don't hold for, by class: types, raw bits, escapes, incomplete codes, negative levels."""
        out = []
        for c, (t, raw, escape) in enumerate(zip(self.types, self.raw, self.escape, strict=True)):
            out += [(c, what, value) for what, value, bad in (("type", t, t > PAIR), ("raw", raw, raw > 16 or t != PAIR and raw > 0), ("escape", escape, escape > 24)) if bad]
            own = self.books[c]
            if own and abs(own.share - 1) > 1e-9:
                out.append((c, "code", sum(n > 0 for n in own.lengths)))
            out += [(c, "offset", v) for m, v in enumerate(self.offsets[c]) if m and v > 16 * m - 1]
        return out + [(len(self.types), "context", s) for s, b in enumerate(self.contexts) if abs(b.share - 1) > 1e-9]

    def census(self) -> dict[str, int]:
        return {"zero": self.types.count(ZERO), "quad": self.types.count(QUAD), "pair": self.types.count(PAIR), "max_raw": max(self.raw), "max_escape": max(self.escape)}


def _read_golomb(b: Bits, k: int) -> int:
    z = b.unary()
    if z > 24:
        raise ContainerError("an escape that is too long")
    return ((1 << z) - 1 + b.read(z)) << k | (b.read(k) if k else 0)


def _put_golomb(w: BitWriter, v: int, k: int) -> None:
    high = (v >> k) + 1
    w.put(high, 2 * high.bit_length() - 1)
    if k:
        w.put(v, k)


def words_to_bits(stream: bytes) -> bytes:
    """The stream with each 16-bit word's bytes swapped: then bits run in plain order. Its own inverse."""
    out = bytearray(stream)
    out[::2], out[1::2] = stream[1::2], stream[::2]
    return bytes(out)


def read_channel(b: Bits, t: Tables, ops: dict[str, int]) -> list[tuple[int, list[int]]]:
    """(class, 16 magnitudes with sign) of the bands up to the end symbol."""
    k = context = len(t.types)
    bands = []
    for _ in range(BANDS):
        c = t.contexts[context].read(b)
        ops["bandsyms"] += 1
        if c == k:
            break
        context, m = c, [0] * WIDTH
        if t.types[c] != ZERO:
            ops["coded_bands"] += 1
            per, base, top = (2, 16, 15) if t.types[c] == PAIR else (4, 3, 2)
            for i in range(0, WIDTH, per):
                s = t.books[c].read(b)
                ops["pairs" if per == 2 else "quads"] += 1
                for j in range(per):
                    v = s // base ** (per - 1 - j) % base
                    if v == top:
                        v += _read_golomb(b, t.escape[c])
                        ops["escs"] += 1
                    if per == 2 and t.raw[c]:
                        v = v << t.raw[c] | b.read(t.raw[c])
                        ops["raws"] += 1
                    m[i + j] = -v if v and b.read(1) else v
            ops["nz"] += sum(v != 0 for v in m)
            ops["zc"] += sum(v == 0 for v in m)
        bands.append((c, m))
    return bands


def write_channel(w: BitWriter, t: Tables, bands: list[tuple[int, list[int]]]) -> None:
    """The inverse; the end symbol is left out after the last band."""
    k = context = len(t.types)
    for c, m in bands:
        t.contexts[context].write(w, c)
        context = c
        if t.types[c] == ZERO:
            continue
        pair = t.types[c] == PAIR
        per, base, top = (2, 16, 15) if pair else (4, 3, 2)
        raw = t.raw[c] if pair else 0
        for i in range(0, WIDTH, per):
            heads = [min(abs(v) >> raw, top) for v in m[i : i + per]]
            s = 0
            for h in heads:
                s = s * base + h
            t.books[c].write(w, s)
            for v, h in zip(m[i : i + per], heads, strict=True):
                if h == top:
                    _put_golomb(w, (abs(v) >> raw) - top, t.escape[c])
                if raw:
                    w.put(abs(v), raw)
                if v:
                    w.put(v < 0, 1)
    if len(bands) < BANDS:
        t.contexts[context].write(w, k)


def write_frames(frames: list[dict], t: Tables) -> tuple[bytes, list[tuple[int, int]]]:
    """frames (g, ms, channels) -> padded stream, and (bit position, g before) of every frame."""
    w, before, places, bits = BitWriter(), 0, [], 0
    for f in frames:
        places.append((len(w.done) * 8 + w.n, before))
        d = f["g"] - before
        _put_golomb(w, 2 * d if d >= 0 else -2 * d - 1, 0)
        w.put(f["ms"], 1)
        for channel in f["channels"]:
            write_channel(w, t, channel)
        before = f["g"]
    bits = len(w.done) * 8 + w.n
    words = (bits + 15 >> 4) + 4
    words += words % 2
    return words_to_bits(w.bytes().ljust(2 * words, b"\0")), places


def read_frames(stream: bytes, t: Tables, at: int, before: int, n: int) -> Iterator[dict]:
    """n frames from a bit position on, given the step before."""
    b = Bits(words_to_bits(stream))
    b.at = at
    for _ in range(n):
        start = b.at
        ops = dict.fromkeys(("bandsyms", "coded_bands", "pairs", "quads", "nz", "zc", "raws", "escs"), 0)
        z = _read_golomb(b, 0)
        before += -(z + 1 >> 1) if z & 1 else z >> 1
        ms = b.read(1)
        if not 0 <= before - 4 * ms < STEPS:
            raise ContainerError(f"step {before}")
        channels = [read_channel(b, t, ops) for _ in range(2)]
        yield {"g": before, "ms": ms, "channels": channels, "bitpos": start, "bits": b.at - start, "ops": ops}


def read_symbols(files: DataFrame) -> DataFrame:
    """files (path, content) -> a row per frame. Frames are read in segments, one a seek entry, so a file's frames spread over tasks."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                m = parse_ula2(bytes(content))
                n = m["header"]["frames"]
                ends = [s["bitpos"] for s in m["seeks"][1:]] + [16 * len(m["stream"]) // 2]
                for i, (s, end) in enumerate(zip(m["seeks"], ends, strict=True)):
                    first, last = s["bitpos"] // 16 * 2, min(len(m["stream"]), end // 16 * 2 + 16)
                    yield pd.DataFrame({"path": [path], "segment": [i], "frames": [min(256, n - 256 * i)], "bitpos": [s["bitpos"]], "g_prev": [s["g_prev"]], "base": [first * 8], "tables": [m["tables"]], "part": [m["stream"][first:last]]})

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, Tables] = {}  # an album's segments follow one another
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows, blob = [], bytes(r.tables)
                if blob not in known:
                    known.clear()
                    known[blob] = Tables.parse(blob)
                for j, f in enumerate(read_frames(bytes(r.part), known[blob], r.bitpos - r.base, r.g_prev, r.frames)):
                    rows.append((r.path, 256 * r.segment + j, f["bitpos"] + r.base, f["bits"], f["g"], bool(f["ms"]), [[{"class": c, "m": m} for c, m in ch] for ch in f["channels"]], *f["ops"].values()))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("path", "frame", "bitpos", "bits", "g", "ms", "channels", "bandsyms", "coded_bands", "pairs", "quads", "nz", "zc", "raws", "escs")])

    parts = files.select("path", "content").mapInPandas(segments, "path string, segment int, frames int, bitpos long, g_prev int, base long, tables binary, part binary")
    out = "path string, frame int, bitpos long, bits int, g int, ms boolean, channels array<array<struct<class:int,m:array<int>>>>, bandsyms int, coded_bands int, pairs int, quads int, nz int, zc int, raws int, escs int"
    return parts.repartition("path", "segment").mapInPandas(frames, out)


def cycles(frames: DataFrame) -> DataFrame:
    """The linear cost of each frame of read_symbols (long code words are not counted apart)."""
    from strandline.plans.q_scalar import cost_of

    return frames.withColumn("long_codes", F.lit(0)).withColumn("cycles", cost_of(F.col("ms")))


__all__ = ["Book", "Short", "Tables", "canonical", "cycles", "read_channel", "read_frames", "read_symbols", "words_to_bits", "write_channel", "write_frames"]
