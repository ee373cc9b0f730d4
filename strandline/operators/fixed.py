"""Fixed-point lapped synthesis: bit-exact 32-bit arithmetic on arrays of frames, tables from their rules.

All products are 64-bit and keep their high half; sums wrap at 32 bits. A frame is 512 coefficients.
"""

from __future__ import annotations

from functools import cache

import numpy as np

HOP, HALF = 512, 256


def wrap(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32).astype(np.int64)


def _high(x: np.ndarray) -> np.ndarray:
    return x >> 32


@cache
def steps() -> np.ndarray:
    """Quantiser steps: eight to an octave."""
    return np.floor(2.0 ** (np.arange(192) / 8) + 0.5).astype(np.int64)


def _unit(angle: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """cos and -sin of angles as fixed-point, rounded half up in magnitude and clamped below one."""

    def q(v):
        return np.minimum(np.sign(v) * np.floor(np.abs(v) * 2.0**bits + 0.5), (1 << 31) - 1).astype(np.int64)

    return q(np.cos(angle)), q(-np.sin(angle))


@cache
def tables() -> dict[str, tuple[np.ndarray, ...]]:
    k = np.arange(HALF)
    digits = [(k >> s) & 3 for s in (0, 2, 4, 6)]
    order = (digits[0] << 6) | (digits[1] << 4) | (digits[2] << 2) | digits[3]
    window = np.floor(np.sin(np.pi * (np.arange(HOP) + 0.5) / 1024) * 2.0**30 + 0.5).astype(np.int64)
    return {"before": _unit(np.pi * (4 * k + 1) / 2048, 31), "after": _unit(np.pi * k / 512, 31), "order": (order,), "window": (window,)}


def _turn(re: np.ndarray, im: np.ndarray, w: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Complex product, high halves."""
    return wrap(_high(re * w[0] - im * w[1])), wrap(_high(re * w[1] + im * w[0]))


def fft256(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radix-4 transform of 256 points, frequencies in digit-reversed order, scaled by a quarter a stage."""
    frames = re.shape[0]
    size = HALF
    while size >= 4:
        q = size // 4
        r, i = (x.reshape(frames, HALF // size, 4, q) for x in (re, im))
        sums = [wrap(x[:, :, 0] + x[:, :, 2]) for x in (r, i)], [wrap(x[:, :, 1] + x[:, :, 3]) for x in (r, i)]
        gaps = [wrap(x[:, :, 0] - x[:, :, 2]) for x in (r, i)], [wrap(x[:, :, 1] - x[:, :, 3]) for x in (r, i)]
        (even_r, even_i), (odd_r, odd_i) = sums
        (dr, di), (er, ei) = gaps
        outs = [(even_r + odd_r, even_i + odd_i), (dr + ei, di - er), (even_r - odd_r, even_i - odd_i), (dr - ei, di + er)]
        parts = []
        for m, (a, b) in enumerate(outs):
            a, b = wrap(a), wrap(b)
            parts.append((a >> 2, b >> 2) if m == 0 or size == 4 else _turn(a, b, _unit(2 * np.pi * np.arange(q) * m / size, 30)))
        re, im = (np.stack([p[c] for p in parts], 2).reshape(frames, HALF) for c in (0, 1))
        size = q
    return re, im


def imdct(x: np.ndarray) -> np.ndarray:
    """frames x 512 integers, to be windowed."""
    t = tables()
    x = wrap(np.asarray(x, np.int64))
    re, im = _turn(x[:, ::2], x[:, ::-1][:, ::2], t["before"])
    re, im = fft256(re, im)
    order = t["order"][0]
    re, im = _turn(re[:, order], im[:, order], t["after"])
    y = np.empty_like(x)
    y[:, ::2] = re
    y[:, ::-1][:, ::2] = wrap(-im)
    return y


def overlap(y: np.ndarray, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit samples, 16-bit samples (frames x 512) and the tail for the frame after. tail: 256 values kept from the frame before."""
    w = tables()["window"][0]
    keep = y[:, :HALF][:, ::-1]  # what each frame leaves, last first
    before = np.concatenate([(np.zeros(HALF, np.int64) if tail is None else tail)[None, :], keep[:-1, ::-1]])[:, ::-1]
    a, b, up, down = y[:, HALF:], before, w[:HALF], w[::-1][:HALF]
    one, two = a * up - b * down, -a * down - b * up
    eight, sixteen = np.empty_like(y), np.empty_like(y)
    for acc, at in ((one, slice(0, HALF)), (two, slice(HALF, HOP))):
        flip = acc if at.start == 0 else acc[:, ::-1]
        eight[:, at] = np.clip(wrap(_high(flip + (1 << 39))) >> 8, -128, 127)
        sixteen[:, at] = np.clip(wrap(_high(flip + (1 << 31))), -32768, 32767)
    return eight, sixteen, y[-1, :HALF].copy()


def dequantise(bands: list[tuple[int, list[int]]], offsets: list[list[int]], step: int) -> np.ndarray:
    """512 coefficients of one channel's bands: (16 |m| - offset) * step, with the sign of m."""
    x = np.zeros(HOP, np.int64)
    for b, (c, m) in enumerate(bands):
        for i, v in enumerate(m):
            if v:
                q = (16 * abs(v) - offsets[c][min(abs(v), 15)]) * step
                x[16 * b + i] = q if v > 0 else -q
    return wrap(x)


def synthesise(frames: list[dict], offsets: list[list[int]], tails: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Consecutive symbol frames -> 8-bit and 16-bit samples, both 2 x n, and the tails."""
    x = np.zeros((2, len(frames), HOP), np.int64)
    for f, frame in enumerate(frames):
        step = int(steps()[frame["g"] - 4 * frame["ms"]])
        left, right = (dequantise(ch, offsets, step) for ch in frame["channels"])
        x[0, f], x[1, f] = (wrap(left + right), wrap(left - right)) if frame["ms"] else (left, right)
    found = [overlap(imdct(x[c]), None if tails is None else tails[c]) for c in (0, 1)]
    return np.stack([a.ravel() for a, _, _ in found]), np.stack([b.ravel() for _, b, _ in found]), [t for _, _, t in found]
