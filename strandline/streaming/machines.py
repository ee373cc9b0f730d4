"""State machines as data: transition tables and closed forms, used by batches, streams and tests alike."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.digest import FNV64, fnv_of

#: The playback chain and the key machine.
CHUNK, RING_CHUNKS, PREFILL_CHUNKS, UNITY = 560, 36, 16, 256
REPEAT_DELAY, REPEAT_INTERVAL = 24, 8
A, B, SELECT, START, RIGHT, LEFT, UP, DOWN, R, L = (1 << i for i in range(10))
MASK, SOFT_RESET = 1023, L | R | START | A | B
ACTIONS = ((START | A, "pause_toggle"), (RIGHT | R, "next_track"), (LEFT | L, "previous_track"), (DOWN, "restart_track"))
#: Directions that cancel each other.
OPPOSITE = ((RIGHT, LEFT), (UP, DOWN))

# ring


@dataclass
class Ring:
    """A bounded ring by its counters. A push is taken whole or not at all."""

    size: int = CHUNK * RING_CHUNKS
    pushed: int = 0
    consumed: int = 0

    @property
    def ready(self) -> int:
        return self.pushed - self.consumed

    def push(self, n: int) -> bool:
        if self.ready + n > self.size:
            return False
        self.pushed += n
        return True

    def take(self, chunk: int = CHUNK, finished: bool = False) -> tuple[str, int]:
        """('full', chunk), ('tail', what is left at the end of the stream) or ('starved', 0)."""
        ready = self.ready
        verdict, real = ("full", chunk) if ready >= chunk else ("tail", ready) if finished and ready else ("starved", 0)
        self.consumed += real
        return verdict, real

    def truncate(self) -> int:
        dropped, self.consumed = self.ready, self.pushed
        return dropped


@dataclass
class Feed:
    """A ring that frames of samples go into, with a digest of each channel's bytes as they are played.

    A frame goes in whole: one that doesn't fit, whose sides differ in length, or with a sample out of
    16 bits changes neither ring nor digests.
    """

    ring: Ring
    digests: tuple[int, int] = (FNV64[0], FNV64[0])

    def push(self, left: list[int], right: list[int]) -> str | None:
        """Why the frame was refused, or None."""
        if right and len(right) != len(left) or self.ring.ready + len(left) > self.ring.size:
            return "space"
        if any(not -32768 <= v <= 32767 for v in (*left, *right)):
            return "profile"
        self.ring.push(len(left))
        self.digests = tuple(fnv_of(bytes(v >> 8 & 255 for v in x), d, FNV64[1], 64) for x, d in zip((left, right), self.digests, strict=True))
        return None


@dataclass
class Ledger:
    periods: int = 0
    served: int = 0
    underruns: int = 0
    tail_after_end: int = 0
    max_ready: int = 0

    def record(self, verdict: str, finished: bool, ready: int = 0) -> None:
        """A starved period after the end is no underrun."""
        self.periods += 1
        self.max_ready = max(self.max_ready, ready)
        if verdict == "full":
            self.served += 1
        elif verdict == "tail" or finished:
            self.tail_after_end += 1
        else:
            self.underruns += 1


# keys: what is held is the last mask seen twice running; a direction repeats by its place in its run


def _directions(held, both, either):
    """Held directions without their opposites. both(x, mask) and either(conditions and values) fit columns or arrays."""
    return sum(either(both(held, a) & ~both(held, b), a) + either(both(held, b) & ~both(held, a), b) for a, b in OPPOSITE)


def repeats(place):
    """If a direction repeats at this place (from 0) in its run: after the delay, then every interval."""
    return (place >= REPEAT_DELAY) & ((place - REPEAT_DELAY) % REPEAT_INTERVAL == 0)


def key_events(rows: DataFrame, key: str = "key", seq: str = "seq", mask: str = "mask") -> DataFrame:
    """key, seq, held, pressed, released, repeated, action of masks, one a frame, in the order of seq: windows alone.

    During the soft-reset chord nothing is pressed, released or repeated, but what is held goes on.
    """
    w = Window.partitionBy(key).orderBy(seq)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)

    def both(x: Column, m: int) -> Column:
        return x.bitwiseAND(F.lit(m)) == m

    seen = rows.select(key, seq, F.col(mask).bitwiseAND(F.lit(MASK)).cast("int").alias("__m"))
    steady = F.when(F.col("__m") == F.lag("__m").over(w), F.col("__m"))
    held = seen.withColumn("held", F.coalesce(F.last(steady, ignorenulls=True).over(so_far), zero))
    chord = both(F.col("held"), SOFT_RESET)
    way = F.when(chord, zero).otherwise(_directions(F.col("held"), both, lambda c, v: F.when(c, v).otherwise(0)))
    known = held.select("*", F.coalesce(F.lag("held").over(w), zero).alias("__before"), chord.alias("__chord"), way.alias("__way"))
    turned = known.withColumn("__turn", (F.col("__way") != F.coalesce(F.lag("__way").over(w), zero)).cast("int"))
    numbered = turned.withColumn("__at", F.row_number().over(w)).withColumn("__since", F.max(F.when(F.col("__turn") == 1, F.col("__at"))).over(so_far))
    place = F.col("__at") - F.col("__since")
    now, before = F.col("held"), F.col("__before")

    def quiet(value: Column) -> Column:
        return F.when(F.col("__chord"), zero).otherwise(value).cast("int")

    out = numbered.select(
        key, seq, "held", quiet(now.bitwiseAND(F.bitwise_not(before))).alias("pressed"), quiet(before.bitwiseAND(F.bitwise_not(now))).alias("released"),
        F.when((F.col("__way") != 0) & repeats(place), F.col("__way")).otherwise(0).cast("int").alias("repeated"),
    )
    return out.withColumn("action", action_of(F.col("pressed")))


def action_of(pressed: Column) -> Column:
    """The action of the first of ACTIONS that has a pressed key."""
    out = F.lit(None).cast("string")
    for mask, name in reversed(ACTIONS):
        out = F.when(pressed.cast("long").bitwiseAND(F.lit(mask).cast("long")) != 0, name).otherwise(out)
    return out


def action(pressed: int) -> str | None:
    return next((name for mask, name in ACTIONS if pressed & mask), None)


#: What goes from one micro-batch to the next: the last mask (-1: none yet), what was held, the direction, its place.
KEYS_START = (-1, 0, 0, 0)


def key_arrays(masks: np.ndarray, carried: tuple[int, int, int, int] = KEYS_START) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """held, pressed, released, repeated (4 x n) of one key's masks after what was carried, and what to carry on."""
    last, held_before, way_before, place_before = carried
    m = np.asarray(masks, np.int64) & MASK
    if not len(m):
        return np.zeros((4, 0), np.int64), carried
    steady = m == np.append(last, m[:-1])
    source = np.maximum.accumulate(np.where(steady, np.arange(len(m)), -1))
    held = np.where(source >= 0, m[source], held_before)
    before = np.append(held_before, held[:-1])
    chord = held & SOFT_RESET == SOFT_RESET
    way = np.where(chord, 0, _directions(held, lambda x, k: x & k == k, lambda c, v: np.where(c, v, 0)))
    turn = way != np.append(way_before, way[:-1])
    at = np.arange(len(m))
    since = np.maximum.accumulate(np.where(turn, at, -1))
    place = np.where(since >= 0, at - since, place_before + 1 + at)
    out = np.stack([held, np.where(chord, 0, held & ~before), np.where(chord, 0, before & ~held), np.where((way != 0) & repeats(place), way, 0)])
    return out, (int(m[-1]), int(held[-1]), int(way[-1]), int(place[-1]))


# gain and transport


@dataclass(frozen=True)
class Gain:
    """A linear ramp: level in [0, UNITY], slope a sample, chunks to wait at silence before it rises."""

    level: int = UNITY
    slope: int = 0
    wait: int = 0

    def down(self) -> Gain:
        return Gain(self.level, -1, self.wait)

    def up(self) -> Gain:
        return Gain(self.level, 1, 0)

    def up_after(self, chunks: int) -> Gain:
        return Gain(0, 0, chunks) if chunks else self.up()

    def after(self, n: int = CHUNK) -> Gain:
        """The ramp once n samples were scaled by it; a fall ends at silence, and a wait in a rise."""
        level = min(max(self.level + self.slope * n, 0), UNITY)
        slope = 1 if self.wait == 1 else 0 if level == 0 and self.slope < 0 else self.slope
        return Gain(level, slope, max(self.wait - 1, 0))

    @property
    def silent(self) -> bool:
        return self.level == 0 and self.slope == 0


#: state, event -> next state, step, what it does to the gain. A period is 'quiet' when the level is 0 and a whole
#: chunk of silence was handed over in this state, and 'loud' at UNITY; what isn't listed stays and gives OTHERWISE.
TRANSITIONS: dict[tuple[str, str], tuple[str, str, str | None]] = {
    ("playing", "toggle"): ("pausing", "fade_out", "down"),
    ("playing", "toggle_dry"): ("pausing", "fade_out", "down"),
    ("playing", "skip"): ("skipping", "fade_out", "down"),
    ("pausing", "quiet"): ("paused", "freeze", None),
    ("paused", "toggle"): ("resuming", "prime", "up"),
    ("paused", "toggle_dry"): ("buffering", "buffer", None),
    ("buffering", "filled"): ("resuming", "prime", "up"),
    ("skipping", "quiet"): ("skipping", "skip_hand_off", None),
    ("skipping", "cover"): ("repriming", "covered", "cover"),
    ("resuming", "loud"): ("playing", "idle", None),
    ("repriming", "loud"): ("playing", "idle", None),
}
OTHERWISE = {"toggle": "ignored", "toggle_dry": "ignored", "skip": "ignored", "cover": "ignored", "filled": "idle", "quiet": "idle", "loud": "idle", "period": "idle"}
COVER_CHUNKS = 2


@dataclass(frozen=True)
class Transport:
    """Pause, resume, skip and refill, as a walk over TRANSITIONS."""

    state: str = "playing"
    gain: Gain = Gain()
    heard_silence: bool = False

    def on(self, event: str) -> tuple[Transport, str]:
        """The machine after an event ('period' hands a chunk over first), and the step it takes."""
        gain, silence = self.gain, self.heard_silence
        if event == "period":
            silence = silence or gain.silent
            gain = gain.after()
            event = "quiet" if gain.level == 0 and silence else "loud" if gain.level == UNITY else "period"
        state, step, effect = TRANSITIONS.get((self.state, event), (self.state, OTHERWISE[event], None))
        gain = {None: lambda: gain, "down": gain.down, "up": gain.up, "cover": lambda: gain.up_after(COVER_CHUNKS)}[effect]()
        return Transport(state, gain, silence and state == self.state), step
