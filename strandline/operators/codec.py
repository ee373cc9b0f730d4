"""The lossy codec end to end: analysis, rate curves, allocation, class paths, tables, container, and back.

Frames are independent up to the difference of their steps, so analysis, measuring and coding run over
frames in parallel; allocation and table statistics are aggregations. Coded frames are joined to bit
strings a seek entry at a time, by tasks; the driver only moves those to their places in the one
container, whose size the budget bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import fixed, rd, stats
from strandline.operators import transform as T
from strandline.session import materialize
from strandline.sources import containers, uli
from strandline.sources.bitio import BitWriter

#: Window of steps to search, share of the cycle period in rate-distortion, cycles of a period.
LOW_G, HIGH_G, KAPPA, PERIOD = 8, 187, 0.13, 262_144
#: Bytes and bits that a plan keeps back.
SLACK, RESERVE_BITS = 16, 64
#: The analysis scale at which the fixed-point synthesis gives 16-bit samples back.
SCALE = None


def analysis_scale() -> float:
    """Coefficient units per sample unit of an orthonormal transform: what the synthesis undoes, measured once on an impulse."""
    global SCALE
    if SCALE is None:
        hop = fixed.HOP
        s = np.sin(np.arange(hop * 4) * 0.05) * 8000
        padded = np.concatenate([np.zeros(hop), s, np.zeros(hop)])
        frames = np.stack([padded[i * hop : (i + 2) * hop] for i in range(5)]) * T.sine_window(hop)
        _, out, _ = fixed.overlap(fixed.imdct(np.round(T.mdct(frames) * 1024).astype(np.int64)))
        got = out.ravel()[hop:].astype(float)
        SCALE = 1024 / ((got * s).sum() / (s * s).sum())
    return SCALE


def quantise_channel(x: np.ndarray, t: uli.Tables, step: float) -> list[tuple[int, list[int]]]:
    """(class, magnitudes) of the bands, a magnitude of 1 standing for 16 steps less its offset, up to the last one that isn't zero; the lowest class with enough headroom."""
    a = np.abs(x[: uli.CODED]) / (16 * step)
    low = np.minimum(np.floor(a), 65535)
    offset = 3 / 16
    rec = [np.zeros_like(a), np.where(low > 0, low - offset, 0), low + 1 - offset]
    best = np.argmin([np.abs(a - r) for r in rec], 0)
    m = np.choose(best, [np.zeros_like(low), low, low + 1]).astype(int) * np.sign(x[: uli.CODED]).astype(int)
    m = np.concatenate([m, np.zeros(512 - uli.CODED, int)]).reshape(uli.BANDS, uli.WIDTH)
    heads = [0 if c == uli.ZERO else 1 if c == uli.QUAD else (15 << r) - 1 for c, r in zip(t.types, t.raw, strict=True)]
    bands = []
    for row in m:
        most = int(np.abs(row).max())
        c = 0 if not most else next((i for i, h in enumerate(heads) if i and most <= h), len(heads) - 1)
        bands.append((c, row.tolist()))
    while bands and bands[-1][0] == 0:
        bands.pop()
    return bands


def frame_bits(t: uli.Tables, channels: list) -> tuple[BitWriter, int]:
    w = BitWriter()
    for ch in channels:
        uli.write_channel(w, t, ch)
    return w, len(w.done) * 8 + w.n


def channel_bits(t: uli.Tables, bands: list[tuple[int, list[int]]]) -> int:
    """Bits that write_channel takes, without writing them."""
    k = before = len(t.types)
    total = 0
    for c, m in bands:
        total += t.contexts[before].lengths[c]
        before = c
        if t.types[c] == uli.ZERO:
            continue
        pair = t.types[c] == uli.PAIR
        per, base, top, raw = (2, 16, 15, t.raw[c]) if pair else (4, 3, 2, 0)
        lengths, escape = t.books[c].lengths, t.escape[c]
        values = [abs(v) for v in m]
        total += len(values) * raw + sum(v > 0 for v in values)
        heads = [v >> raw for v in values]
        for i in range(0, len(heads), per):
            s = 0
            for h in heads[i : i + per]:
                if h >= top:
                    total += 2 * ((h - top >> escape) + 1).bit_length() - 1 + escape
                    h = top
                s = s * base + h
            total += lengths[s]
    return total + (t.contexts[before].lengths[k] if len(bands) < uli.BANDS else 0)


def band_choice(x: np.ndarray, t: uli.Tables, c: int, step: float, lam: float, most: int = 65535) -> tuple[list[int], float, int] | None:
    """Magnitudes of one band under class c with the least distortion + lam * bits: every tuple of 2 or 4 is searched whole.

    Candidates of a coefficient are zero, the floor and the one above it; distortion is in units of the
    coefficients. None if the class has no word for any choice.
    """
    from itertools import product

    pair = t.types[c] == uli.PAIR
    per, base, top = (2, 16, 15) if pair else (4, 3, 2)
    raw = t.raw[c] if pair else 0
    out: list[int] = []
    dist, bits = 0.0, 0
    for i in range(0, len(x), per):
        tries = []
        for v in np.abs(x[i : i + per]):
            low = min(int(v / (16 * step)), most)
            tries.append(sorted({0, low, min(low + 1, most)}))
        best = None
        for m in product(*tries):
            s, n, e = 0, 0, 0.0
            for v, k in zip(np.abs(x[i : i + per]), m, strict=True):
                head = min(k >> raw, top)
                s = s * base + head
                n += raw + (k > 0) + (2 * (((k >> raw) - top >> t.escape[c]) + 1).bit_length() - 1 + t.escape[c] if head == top else 0)
                e += (v - (16 * k - t.offsets[c][min(k, 15)] if k else 0) * step) ** 2
            if t.books[c].lengths[s]:
                n += t.books[c].lengths[s]
                if best is None or e + lam * n < best[0]:
                    best = (e + lam * n, m, e, n)
        if best is None:
            return None
        out += [int(k * np.sign(v)) for k, v in zip(best[1], x[i : i + per], strict=True)]
        dist, bits = dist + best[2], bits + best[3]
    return out, dist, bits


def _golomb_bits(v: np.ndarray, k: int) -> np.ndarray:
    return 2 * np.floor(np.log2((v >> k) + 1)).astype(int) + 1 + k


def class_choices(x: np.ndarray, t: uli.Tables, step: float, lam: float, most: int = 65535) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every band and class the least distortion + lam * bits, its bits and its magnitudes, all tuples searched side by side.

    inf where a class has no word for any choice. The zero class leaves the whole band out.
    """
    k, n = len(t.types), uli.BANDS * uli.WIDTH
    a = np.zeros(n)
    a[: uli.CODED] = np.abs(x[: uli.CODED])
    low = np.minimum(np.floor(a / (16 * step)), most).astype(np.int64)
    tries = np.stack([np.zeros_like(low), low, np.minimum(low + 1, most)])
    tries[2, uli.CODED :] = 0
    cost, bits, mags = np.full((uli.BANDS, k), np.inf), np.zeros((uli.BANDS, k), int), np.zeros((k, n), np.int64)
    for c, kind in enumerate(t.types):
        if kind == uli.ZERO:
            cost[:, c] = np.square(a).reshape(uli.BANDS, -1).sum(1)
            continue
        per, base, top = (2, 16, 15) if kind == uli.PAIR else (4, 3, 2)
        raw = t.raw[c] if kind == uli.PAIR else 0
        off = np.array(t.offsets[c])[np.minimum(tries, 15)]
        error = np.square(a - np.where(tries > 0, (16 * tries - off) * step, 0))
        head = np.minimum(tries >> raw, top)
        tail = raw + (tries > 0) + np.where(head == top, _golomb_bits(np.maximum((tries >> raw) - top, 0), t.escape[c]), 0)
        pick = np.array(list(np.ndindex(*[3] * per)))  # choices x places
        at = np.arange(0, n, per)
        symbol = sum(head[pick[:, j][:, None], at + j] * base ** (per - 1 - j) for j in range(per))
        length = np.array(t.books[c].lengths)[symbol]
        size = length + sum(tail[pick[:, j][:, None], at + j] for j in range(per))
        total = sum(error[pick[:, j][:, None], at + j] for j in range(per)) + lam * size
        total[length == 0] = np.inf
        best = total.argmin(0)
        groups = np.arange(len(at))
        cost[:, c] = total[best, groups].reshape(uli.BANDS, -1).sum(1)
        bits[:, c] = size[best, groups].reshape(uli.BANDS, -1).sum(1)
        for j in range(per):
            mags[c, at + j] = tries[pick[best, j], at + j]
    return cost, bits, mags


def best_channel(x: np.ndarray, t: uli.Tables, step: float, lam: float) -> list[tuple[int, list[int]]]:
    """(class, magnitudes) of the bands with the least distortion + lam * bits of the whole channel.

    A best path over bands and classes: a class costs its band and its own symbol after the class before.
    The channel may end after any band, which costs the end symbol and the distortion of what is left out.
    """
    cost, _, mags = class_choices(x, t, step, lam)
    k = len(t.types)
    moves = np.array([b.lengths[:k] for b in t.contexts], float)
    moves[moves == 0] = np.inf
    ends = np.array([b.lengths[k] or np.inf for b in t.contexts], float) * lam
    left_out = np.append(np.cumsum(np.square(np.append(x[: uli.CODED], np.zeros(512 - uli.CODED))).reshape(uli.BANDS, -1).sum(1)[::-1])[::-1], 0.0)
    best, path_end, back = ends[k] + left_out[0], (0, None), []
    total = lam * moves[k] + cost[0]
    for b in range(uli.BANDS):
        if b:
            via = total[:, None] + lam * moves[:k]
            back.append(via.argmin(0))
            total = via.min(0) + cost[b]
        done = total + (ends[:k] if b + 1 < uli.BANDS else 0) + left_out[b + 1]
        if done.min() < best:
            best, path_end = done.min(), (b + 1, int(done.argmin()))
    bands, at = path_end
    path = [at] if bands else []
    for b in range(bands - 1, 0, -1):
        path.append(int(back[b - 1][path[-1]]))
    sign = np.where(x[: uli.CODED] < 0, -1, 1)
    sign = np.append(sign, np.ones(512 - uli.CODED, int))
    out = []
    for b, c in enumerate(reversed(path)):
        place = slice(16 * b, 16 * b + 16)
        out.append((c, (mags[c, place] * sign[place]).tolist()))
    while out and t.types[out[-1][0]] == uli.ZERO:
        out.pop()
    return out


def price(step: float) -> float:
    """What a bit costs in distortion at a step."""
    return KAPPA * (16 * step) ** 2


def coefficients(signal: DataFrame, at: str = "i", left: str = "left", right: str = "right") -> DataFrame:
    """frame, lc, rc: coefficients of both channels at the synthesis scale. Frame f ends with sample f * 512."""
    scale = analysis_scale()
    both = signal.select(at, F.explode(F.array(F.struct(F.lit(0).alias("ch"), F.col(left).cast("double").alias("x")), F.struct(F.lit(1).alias("ch"), F.col(right).cast("double").alias("x")))).alias("c"))
    coef = T.analyse(both.select(at, "c.ch", "c.x"), fixed.HOP, ["ch"], at, "x", uli.CODED)
    scaled = coef.select("ch", "frame", F.transform("coef", lambda v: v * scale).alias("coef"))
    return scaled.groupBy("frame").agg(F.max(F.when(F.col("ch") == 0, F.col("coef"))).alias("lc"), F.max(F.when(F.col("ch") == 1, F.col("coef"))).alias("rc"))


def _sides(l: np.ndarray, r: np.ndarray, ms: int) -> tuple[np.ndarray, np.ndarray]:
    return ((l + r) / 2, (l - r) / 2) if ms else (l, r)


def measure(l: np.ndarray, r: np.ndarray, t: uli.Tables, g: int, cap: float = PERIOD) -> tuple[int, float, float, int]:
    """(ms, bits, distortion, cycles) of a frame at a step; of left/right and mid/side the one within the cap, then the cheaper one."""
    tried = []
    for ms in (0, 1):
        step = int(fixed.steps()[g - 4 * ms])
        parts = _sides(l, r, ms)
        channels = [quantise_channel(p, t, step) for p in parts]
        bits = sum(channel_bits(t, ch) for ch in channels)
        back = [fixed.dequantise(ch, t.offsets, step)[: uli.CODED] for ch in channels]
        d = sum(float(np.square(p - b).sum()) for p, b in zip(parts, back, strict=True)) * (2 if ms else 1)
        nonzero = sum(v != 0 for ch in channels for _, m in ch for v in m)
        cycles = 155_466 + 22 * nonzero + 74 * sum(len(ch) for ch in channels) + 1536 * ms
        tried.append((cycles > cap, d + price(step) * bits, ms, float(bits), d, cycles))
    return min(tried)[2:]


_CURVE = "frame long, g int, ms int, r double, d double, c long"


def _measured(frames: DataFrame, tables: bytes, steps_of, cap: float) -> DataFrame:
    """frame, g, ms, r (bits), d (distortion), c (cycles) of the steps that steps_of names for a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = uli.Tables.parse(tables)
        for batch in batches:
            rows = [(f.frame, g, *measure(np.asarray(f.lc), np.asarray(f.rc), t, g, cap)) for f in batch.itertuples(index=False) for g in steps_of(f)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CURVE.split(", ")])

    return frames.mapInPandas(run, _CURVE)


def curves(frames: DataFrame, stride: int = 12, tables: bytes | None = None, cap: float = PERIOD) -> DataFrame:
    """The coarse curves of frames (frame, lc, rc): steps LOW_G to HIGH_G by a stride, and the last one."""
    grid = sorted({*range(LOW_G, HIGH_G + 1, stride), HIGH_G})
    return _measured(frames.select("frame", "lc", "rc"), tables or uli.Tables.default().blob(), lambda _: grid, cap)


def refine(frames: DataFrame, coarse: DataFrame, picks: DataFrame, width: int, tables: bytes | None = None, cap: float = PERIOD) -> DataFrame:
    """Curves of every step up to width away from the coarse choice (frame, g); coarse points are used again."""
    asked = frames.join(picks.select("frame", F.col("g").alias("centre")), "frame").select("frame", "lc", "rc", "centre")
    known = coarse.groupBy("frame").agg(F.collect_set("g").alias("known"))
    wanted = asked.join(known, "frame").select("frame", "lc", "rc", "centre", "known")
    fresh = _measured(wanted, tables or uli.Tables.default().blob(), lambda f: [g for g in range(max(LOW_G, f.centre - width), min(HIGH_G, f.centre + width) + 1) if g not in set(f.known)], cap)
    near = coarse.join(picks.select("frame", F.col("g").alias("centre")), "frame").where(F.abs(F.col("g") - F.col("centre")) <= width).select(*fresh.columns)
    return near.union(fresh)


def weights(frames: DataFrame, tracks: list[dict]) -> DataFrame:
    """frame, w: a frame's weight is its track's, by loudness; frames before and after all tracks take the nearest track's."""
    energy = frames.select("frame", F.aggregate("lc", F.lit(0.0), lambda a, v: a + v * v).alias("l"), F.aggregate("rc", F.lit(0.0), lambda a, v: a + v * v).alias("r")).select("frame", (F.col("l") + F.col("r")).alias("energy"))
    track = F.lit(0)
    for i, row in enumerate(tracks):  # at most 32
        track = F.when(F.col("frame") * fixed.HOP > row["start_sample"], i).otherwise(track)
    placed = energy.withColumn("track", track)
    each = stats.loudness_weights(placed, "track", "energy", "w")
    return placed.join(F.broadcast(each), "track").select("frame", "w")  # at most 32 rows


class BudgetError(ValueError):
    """What an album needs is more than what it may take; both numbers are there."""

    def __init__(self, needed: int, allowed: int):
        super().__init__(f"{needed} bytes are needed, {allowed} are allowed")
        self.needed, self.allowed = needed, allowed


def plan(samples: int, tracks: list[dict], budget: int, tables: bytes) -> dict[str, int]:
    """frames, seeks, overhead and the bits that are left for frames in a budget of bytes."""
    frames = -(-samples // fixed.HOP) + 1
    seeks = -(-frames // 256)
    pool, _ = containers.build_pool([s for t in tracks for s in (t["title"], t["artist"])])
    if len(pool) > 65536:
        raise ValueError(f"{len(pool)} bytes of strings are beyond 16-bit offsets")
    overhead = 88 + 24 * len(tracks) + len(tables) + 8 * seeks + len(pool) + SLACK
    bits = (budget - overhead) * 8 - RESERVE_BITS
    if bits <= 0:
        raise BudgetError(overhead, budget)
    return {"frames": frames, "seeks": seeks, "overhead": overhead, "bits": bits}


_CODED = "frame long, g int, ms int, bits long, body binary, nonzero int, cycles long, cb array<int>, books array<int>, centres array<struct<c:int,m:int,s:double,n:int>>"


def code(frames: DataFrame, tables: bytes) -> DataFrame:
    """Bits of frames (frame, g, ms, lc, rc): along the best class path where that takes no more than the plain choice, and what was used."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, steps = uli.Tables.parse(tables), fixed.steps()
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                step = int(steps[f.g - 4 * f.ms])
                parts = _sides(np.asarray(f.lc), np.asarray(f.rc), f.ms)
                found = [frame_bits(t, channels)[::-1] + (channels,) for channels in ([best_channel(p, t, step, price(step)) for p in parts], [quantise_channel(p, t, step) for p in parts])]
                bits, w, channels = min(found, key=lambda x: x[0])
                nonzero = sum(v != 0 for ch in channels for _, m in ch for v in m)
                rows.append((f.frame, f.g, f.ms, bits, w.bytes(), nonzero, 155_466 + 22 * nonzero + 74 * sum(len(ch) for ch in channels) + 1536 * f.ms, *_used(parts, channels, t, step)))
            yield pd.DataFrame(rows, columns=["frame", "g", "ms", "bits", "body", "nonzero", "cycles", "cb", "books", "centres"])

    return frames.select("frame", "g", "ms", "lc", "rc").mapInPandas(run, _CODED)


def _used(parts, channels, t: uli.Tables, step: int) -> tuple[list[int], list[int], list[dict]]:
    """Class symbols (before * 32 + symbol), book symbols (class * 256 + symbol), and sums of what magnitudes of 1 to 15 stand for."""
    k, cb, books, centres = len(t.types), [], [], {}
    for x, bands in zip(parts, channels, strict=True):
        a = np.append(np.abs(x[: uli.CODED]), np.zeros(512 - uli.CODED)) / step
        before = k
        for b, (c, m) in enumerate(bands):
            cb.append(before * 32 + c)
            before = c
            if t.types[c] == uli.ZERO:
                continue
            per, base, top, raw = (2, 16, 15, t.raw[c]) if t.types[c] == uli.PAIR else (4, 3, 2, 0)
            for i in range(0, 16, per):
                symbol = 0
                for v in m[i : i + per]:
                    symbol = symbol * base + min(abs(v) >> raw, top)
                books.append(c * 256 + symbol)
            for i, v in enumerate(m):
                if 0 < abs(v) < 16:
                    s, n = centres.get((c, abs(v)), (0.0, 0))
                    centres[c, abs(v)] = (s + 16 * abs(v) - float(a[16 * b + i]), n + 1)
        if len(bands) < uli.BANDS:
            cb.append(before * 32 + k)
    return cb, books, [{"c": c, "m": m, "s": s, "n": n} for (c, m), (s, n) in centres.items()]


def retrain(coded: DataFrame, tables: bytes, least: int = 20) -> uli.Tables:
    """Tables from what coded frames used: one aggregation each of class, book and centre counts, whose sizes the format bounds.

    Contexts and classes that weren't used keep their lengths, and centres of few values their offsets.
    """
    t = uli.Tables.parse(tables)
    k = len(t.types)
    pairs = {name: {r["v"]: r["n"] for r in coded.select(F.explode(name).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()} for name in ("cb", "books")}
    for s in range(k + 1):
        counts = [pairs["cb"].get(s * 32 + c, 0) for c in range(k + 1)]
        if any(counts):
            t.contexts[s] = uli.Book(stats.code_lengths([n + 0.5 for n in counts], floor=0.5))
    for c in range(k):
        counts = [pairs["books"].get(c * 256 + s, 0) for s in range(len(t.books[c].lengths))] if t.books[c] else []
        if any(counts):
            t.books[c] = uli.Book(stats.code_lengths([n + 0.5 for n in counts], floor=0.5))
    centres = coded.select(F.explode("centres").alias("x")).groupBy("x.c", "x.m").agg(F.sum("x.s").alias("s"), F.sum("x.n").alias("n")).where(F.col("n") > least).collect()
    for r in centres:
        t.offsets[r["c"]][r["m"]] = int(max(-8, min(15, round(r["s"] / r["n"]))))
    return t


def _bit_strings(coded: DataFrame) -> list[tuple[int, bytes, list[tuple[int, int]]]]:
    """Per seek entry, in order: bits, their bytes, and (place in it, step before) of each frame. A task joins an entry's frames."""
    before = coded.select((F.col("frame") + 1).alias("frame"), F.col("g").alias("before"))
    rows = coded.select("frame", "g", "ms", "bits", "body").join(before, "frame", "left").withColumn("entry", F.expr("frame div 256"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, places, at = [], [], 0
        for f in pdf.sort_values("frame").itertuples(index=False):
            last = 0 if pd.isna(f.before) else int(f.before)
            w = BitWriter()
            d = f.g - last
            uli._put_golomb(w, 2 * d if d >= 0 else -2 * d - 1, 0)
            w.put(f.ms, 1)
            n = len(w.done) * 8 + w.n
            parts += [np.unpackbits(np.frombuffer(w.bytes(), np.uint8))[:n], np.unpackbits(np.frombuffer(f.body, np.uint8))[: f.bits]]
            places.append({"at": at, "before": last})
            at += n + f.bits
        return pd.DataFrame({"entry": [pdf["entry"].iloc[0]], "bits": [at], "body": [np.packbits(np.concatenate(parts)).tobytes()], "places": [places]})

    out = rows.groupBy("entry").applyInPandas(run, "entry long, bits long, body binary, places array<struct<at:long,before:int>>")
    return [(r["bits"], bytes(r["body"]), [(p["at"], p["before"]) for p in r["places"]]) for r in out.orderBy("entry").collect()]  # the container's own size


def join_bits(parts: list[tuple[int, bytes]]) -> tuple[bytes, list[int]]:
    """Bit strings one after the other, and where each begins: a part is shifted as a whole and its first byte joined to the one before."""
    out, starts, at = bytearray(), [], 0
    for n, raw in parts:
        starts.append(at)
        shift = at % 8
        if n:
            size = (shift + n + 7) // 8
            moved = (int.from_bytes(raw, "big") >> (len(raw) * 8 - n) << (size * 8 - shift - n)).to_bytes(size, "big")
            if shift:
                out[-1] |= moved[0]
                moved = moved[1:]
            out += moved
        at += n
    return bytes(out), starts


def encode(signal: DataFrame, samples: int, bits: float, tracks: list[dict], cap: float = 0.9 * PERIOD, stride: int = 12, width: int = 6, train: bool = True) -> bytes:
    """An album of a stereo signal (i, left, right) whose frames take at most so many bits. tracks: start_sample, samples, title, artist.

    Coarse curves locate each frame's step under the common price; the second sweep measures the steps
    around it, and the allocation is made again. Then the frames are coded along their best class paths,
    tables are trained on what they used, and both sweeps' last allocation is made again under those;
    if that doesn't come out smaller at no more distortion, the first result stays.
    """
    frames = materialize(coefficients(signal), "coefficients")
    w = materialize(weights(frames, tracks), "weights")
    tables, best = uli.Tables.default().blob(), None
    for turn in range(1 + train):
        coarse = materialize(curves(frames, stride, tables, cap).join(w, "frame"), "curves")
        _, picks = rd.allocate(coarse, "frame", bits, cap, weight="w")
        fine = materialize(refine(frames, coarse, picks, width, tables, cap).join(w, "frame"), "curves")
        _, picks = rd.allocate(fine, "frame", bits, cap, weight="w")
        chosen = picks.select("frame", "g").join(fine.select("frame", "g", "ms", "d", "w"), ["frame", "g"])
        coded = materialize(code(chosen.join(frames, "frame"), tables), "coded")
        loss = chosen.agg(F.sum(F.col("d") * F.col("w"))).first()[0]
        if best is None or loss < best[0]:
            best = (loss, tables, coded)
        if train and not turn:
            tables = retrain(coded, tables).blob()
    return assemble(best[2], best[1], samples, tracks)


def quantise_all(signal: DataFrame, samples: int, g: int, tracks: list[dict]) -> bytes:
    """An album with one step for all frames, without a search."""
    frames = coefficients(signal).withColumn("g", F.lit(g)).withColumn("ms", F.lit(0))
    return assemble(materialize(code(frames, uli.Tables.default().blob()), "coded"), uli.Tables.default().blob(), samples, tracks)


def assemble(coded: DataFrame, tables: bytes, samples: int, tracks: list[dict]) -> bytes:
    """The container of coded frames, with its cost estimates written last."""
    entries = _bit_strings(coded)
    body, starts = join_bits([(n, raw) for n, raw, _ in entries])
    places = [(start + at, before) for start, (_, _, own) in zip(starts, entries, strict=True) for at, before in own]
    words = (sum(n for n, _, _ in entries) + 15 >> 4) + 4
    stream = uli.words_to_bits(body.ljust(2 * (words + words % 2), b"\0"))
    placed = [t | {"preroll_frame": t["start_sample"] // fixed.HOP, "skip": t["start_sample"] % fixed.HOP} for t in tracks]
    cost = coded.agg(F.max("cycles").alias("most"), F.expr("sum(cycles) div count(*)").alias("mean")).first()
    return containers.with_cycles(containers.build_ula2(placed, places, tables, stream, samples), cost["most"], cost["mean"])


def facts(coded: DataFrame) -> DataFrame:
    """frames, mid/side frames, coefficients that aren't zero, bits: one row."""
    return coded.agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("ms") != 0).alias("ms_frames"), F.sum("nonzero").alias("nonzero"), F.sum("bits").alias("bits"))


def decode(blob: bytes, first: int = 0, frames: int | None = None) -> np.ndarray:
    """16-bit samples, 2 x n, of an album from a frame on; the first frame read only fills the overlap, and is not heard.

    A seek entry is entered directly, so a late track costs at most 255 frames of reading before it.
    """
    m = containers.parse_ula2(blob)
    t, n = uli.Tables.parse(m["tables"]), m["header"]["frames"]
    entry = m["seeks"][first // 256]
    skip, last = first % 256, n if frames is None else min(n, first + frames + 1)
    read = list(uli.read_frames(m["stream"], t, entry["bitpos"], entry["g_prev"], last - first + skip))[skip:]
    heard = fixed.synthesise(read, t.offsets)[1][:, fixed.HOP :]
    return heard[:, : max(0, m["header"]["samples"] - first * fixed.HOP)]


_PIECES = "path string, start long, samples long, bitpos long, g_prev int, skip int, frames int, tables binary, part binary"


def decoded(files: DataFrame, track: int | None = None, size: int = 256) -> DataFrame:
    """files (path, content) -> path, i, left, right: decode of whole albums, or decode_track, a row a sample, by tasks.

    A task decodes size frames, entered at the seek entry before them, and gets that part of the stream
    alone; a piece's first frame is the last one of the piece before and only fills the overlap. A track's
    pieces begin at its pre-roll frame.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                m = containers.parse_ula2(bytes(content))
                n, whole = m["header"]["frames"], m["header"]["samples"]
                row = {"preroll_frame": 0, "skip": 0, "samples": whole} if track is None else m["tracks"][track]
                heard = min(row["skip"] + row["samples"], whole - row["preroll_frame"] * fixed.HOP)  # from the pre-roll frame on
                ends = [s["bitpos"] for s in m["seeks"][1:]] + [8 * len(m["stream"])]
                for at in range(0, -(-heard // fixed.HOP), size):
                    first = row["preroll_frame"] + at
                    last = min(n, first + size + 1)
                    entry = m["seeks"][first // 256]
                    low, high = entry["bitpos"] // 16 * 2, ends[(last - 1) // 256] // 16 * 2 + 16
                    skip, start = first % 256, at * fixed.HOP - row["skip"]
                    end = min(size * fixed.HOP, heard - at * fixed.HOP)
                    yield pd.DataFrame([(path, start, end, entry["bitpos"] - 8 * low, entry["g_prev"], skip, last - first + skip, m["tables"], m["stream"][low:high])], columns=[c.split()[0] for c in _PIECES.split(", ")])

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                t = uli.Tables.parse(bytes(r.tables))
                read = list(islice(uli.read_frames(bytes(r.part), t, r.bitpos, r.g_prev, r.frames), r.skip, None))
                heard = fixed.synthesise(read, t.offsets)[1][:, fixed.HOP :][:, : r.samples]
                i = r.start + np.arange(heard.shape[1])
                kept = i >= 0  # a track begins inside its first frame
                yield pd.DataFrame({"path": r.path, "i": i[kept], "left": heard[0, kept], "right": heard[1, kept]})

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pieces are few bytes: without a number, all would come to one task
    parts = files.select("path", "content").mapInPandas(pieces, _PIECES).repartition(tasks, "path", "start")
    return parts.mapInPandas(samples, "path string, i long, left int, right int")


def decode_track(blob: bytes, track: int) -> np.ndarray:
    """A track's samples: its pre-roll frame is read first, and what lies before its start is skipped."""
    row = containers.parse_ula2(blob)["tracks"][track]
    frames = -(-(row["skip"] + row["samples"]) // fixed.HOP)
    return decode(blob, row["preroll_frame"], frames)[:, row["skip"] : row["skip"] + row["samples"]]


def snr(x: np.ndarray, y: np.ndarray) -> float:
    e = np.square(x - y).sum()
    return float("inf") if not e else 20 * np.log10(sqrt(np.square(x).sum()) / sqrt(e))
