"""Clocks, geometry and latency bounds of a playback chain, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.bits import bar_cell

#: Fixed values of the chain: counter ticks a second, samples of a chunk and a frame, cycles of a video frame, and what
#: fades, covers and refills take in periods, chunks and frames.
TICKS, CHUNK, FRAME, VIDEO_CYCLES = 16_777_216, 560, 2048, 280_896
FADE_PERIODS, COVER_CHUNKS, PREFILL_SAMPLES = 2, 4, 8960
#: Fixed values of an album's boot check: header, track row, string pool's limit, and the two ends of a track that are read.
HEADER_BYTES, TRACK_BYTES, POOL_BYTES, FIRST_BYTES, LAST_BYTES = 64, 40, 65_536, 32_768, 4096


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative values."""
    return F.floor(a.cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("long")


def ceil_div(a, b) -> Column:
    return _div(_c(a) + _c(b) - 1, _c(b))


def seconds(samples) -> Column:
    """Whole seconds at 16,384 samples a second."""
    return F.shiftright(_c(samples), 14)


def frame_at(sample, block: int = FRAME) -> Column:
    """The frame that begins at a sample; null inside one."""
    return F.when(_c(sample) % block == 0, _div(_c(sample), F.lit(block)))


def first_sample(frame, block) -> Column:
    """The first sample of a frame; null where it passes 36 bits, the most a stream can declare."""
    start = _c(frame) * _c(block)
    return F.when((_c(frame) >= 0) & (start < 1 << 36), start)


def frame_count(samples, block: int = FRAME) -> Column:
    """Frames that hold so many samples; 0 samples stand for an unknown number."""
    return F.when(_c(samples) != 0, ceil_div(samples, block))


def frame_budget(block, rate: int) -> Column:
    """Counter ticks while a frame plays."""
    return _div(_c(block) * TICKS, F.lit(rate))


def shown_position(committed, lead: int, length) -> Column:
    """Where playback stands: what was handed over less the lead, and the end once all was."""
    return F.when(_c(committed) >= _c(length), _c(length)).otherwise(F.greatest(F.lit(0).cast("long"), _c(committed) - lead))


def neighbour(track, tracks: int, step: int) -> Column:
    """The track step further, around the album."""
    return F.pmod(_c(track) + step, F.lit(tracks))


def geometry(rate, chunk, lead_ms, prefill_ms) -> dict[str, Column]:
    """Ticks of a sample and a period, ring and prefill in whole chunks and their samples."""
    ticks = _div(F.lit(TICKS), _c(rate))
    ring, prefill = (ceil_div(_c(ms) * _c(rate), _c(chunk) * 1000) for ms in (lead_ms, prefill_ms))
    return {"ticks_per_sample": ticks, "period_cycles": _c(chunk) * ticks, "ring_chunks": ring, "ring_samples": ring * _c(chunk), "prefill_chunks": prefill, "prefill_samples": prefill * _c(chunk)}


def video_frames(cycles) -> Column:
    """Video frames from a detection to the next period's start: 1 to 3."""
    return F.when(_c(cycles) <= VIDEO_CYCLES, 1).when(_c(cycles) <= 2 * VIDEO_CYCLES, 2).otherwise(3)


def gap_samples(tail_padding, starved) -> Column:
    """Samples of silence between two tracks: padding, starved periods and the cover."""
    return _c(tail_padding) + (_c(starved) + COVER_CHUNKS) * CHUNK


def handoff_bound(pass_periods) -> Column:
    """Periods from a skip's take to its hand-off at most: the fade, or a pass and the period it crosses."""
    return F.greatest(F.lit(FADE_PERIODS).cast("long"), _c(pass_periods) + 1)


def resume_bound(worst_pass_frames, boundary_frames) -> Column:
    """Video frames from a resume to its first sound at most: a refill's passes and the boundary."""
    return _c(worst_pass_frames) * (-(-PREFILL_SAMPLES // FRAME)) + _c(boundary_frames)


def boot_bytes(tracks) -> Column:
    """Bytes that a check at the start reads, whatever the size of the album."""
    return HEADER_BYTES + POOL_BYTES + _c(tracks) * (TRACK_BYTES + FIRST_BYTES + LAST_BYTES)


def elapsed_cell(position, reciprocal) -> Column:
    """The cell of a track's bar for a position in it; reciprocal is the track's own."""
    return bar_cell(position, reciprocal)


def gcd(a, b) -> Column:
    """Greatest common divisor of non-negative LONGs, by at most 92 steps of remainders in the row."""
    start = F.struct(_c(a).alias("a"), _c(b).alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, 0).otherwise(s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])
