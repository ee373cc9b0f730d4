"""State machines: rules, batch runs and streams that give the same rows."""

import random

import numpy as np
import pytest

from strandline.streaming import machines as M
from strandline.streaming.processors import batch, stream


def test_ring_takes_whole_pushes_and_never_counts_the_end_as_starved():
    ring, ledger = M.Ring(1000), M.Ledger()
    assert ring.push(900) and not ring.push(101) and ring.ready == 900
    for finished in (False, False, True, True):
        verdict, real = ring.take(560, finished)
        ledger.record(verdict, finished, ring.ready)
    assert (ledger.periods, ledger.served, ledger.underruns, ledger.tail_after_end) == (4, 1, 1, 2)
    assert ring.push(300) and ring.truncate() == 300 and ring.ready == 0


def keys(masks):
    """One key's events, fed mask by mask."""
    carried, out = M.KEYS_START, []
    for m in masks:
        found, carried = M.key_arrays(np.array([m]), carried)
        out.append(tuple(found[:, 0].tolist()))
    return out


def test_keys_debounce_edges_and_repeat():
    rows = keys([M.A, 0, M.A, M.A, M.A, 0, 0])
    assert [r[1] for r in rows] == [0, 0, 0, M.A, 0, 0, 0] and [r[2] for r in rows] == [0, 0, 0, 0, 0, 0, M.A]
    at = [i for i, r in enumerate(keys([M.RIGHT] * 60)) if r[3]]
    assert at == [1 + M.REPEAT_DELAY + k * M.REPEAT_INTERVAL for k in range(5) if 1 + M.REPEAT_DELAY + k * M.REPEAT_INTERVAL < 60]
    rows = keys([M.SOFT_RESET] * 40)
    assert all(r[1:] == (0, 0, 0) for r in rows) and rows[-1][0] == M.SOFT_RESET
    assert keys([M.RIGHT | M.LEFT] * 60)[-1] == (M.RIGHT | M.LEFT, 0, 0, 0) and {r[3] for r in keys([M.UP | M.RIGHT] * 60)} == {0, M.UP | M.RIGHT}


def test_keys_in_parts_equal_keys_at_once():
    rng = random.Random(1)
    masks = [rng.choice([M.RIGHT, M.RIGHT, M.RIGHT, M.LEFT, M.UP, M.A, M.SOFT_RESET, 0])] * 1
    while len(masks) < 3000:
        masks += [rng.choice([M.RIGHT, M.LEFT, M.UP | M.RIGHT, M.A, M.SOFT_RESET, 0])] * rng.choice([1, 2, 3, 50])
    whole, _ = M.key_arrays(np.array(masks))
    assert keys(masks) == [tuple(c) for c in whole.T.tolist()]


def test_actions_follow_priority():
    assert [M.action(m) for m in (M.A | M.RIGHT, M.R | M.L, M.L | M.DOWN, M.DOWN, M.UP)] == ["pause_toggle", "next_track", "previous_track", "restart_track", None]


def walk(events, machine=None):
    machine, steps = machine or M.Transport(), []
    for event in events:
        machine, step = machine.on(event)
        steps.append((step, machine.state, machine.gain.level))
    return machine, steps


def test_transport_pause_resume_skip_and_refill():
    t, steps = walk(["toggle", "toggle", "skip", "period", "period", "period"])
    assert [s[0] for s in steps] == ["fade_out", "ignored", "ignored", "idle", "freeze", "idle"] and t.state == "paused"
    t, steps = walk(["toggle_dry", "toggle", "filled", "filled", "period", "skip", "period", "period", "period"], t)
    assert [s[0] for s in steps] == ["buffer", "ignored", "prime", "idle", "idle", "fade_out", "idle", "skip_hand_off", "skip_hand_off"]
    t, steps = walk(["cover", "cover", "period", "period", "period", "period"], t)
    assert [s[0] for s in steps[:2]] == ["covered", "ignored"]
    assert [s[1:] for s in steps[2:]] == [("repriming", 0), ("repriming", 0), ("playing", 256), ("playing", 256)]


def test_every_state_is_reached_and_left():
    states = {s for s, _ in M.TRANSITIONS}
    assert states == {to for to, _, _ in M.TRANSITIONS.values()} and len(states) == 7
    assert {e for _, e in M.TRANSITIONS} <= set(M.OTHERWISE)


ROWS = {
    "keys": ("mask int", lambda rng: (rng.choice([0, M.A, M.RIGHT, M.LEFT, M.SOFT_RESET]),)),
    "ring": ("op string, n long", lambda rng: (rng.choice(["push", "take", "truncate", "finish"]), rng.choice([100, 560, 5000]))),
    "feed": ("op string, n long, left array<int>, right array<int>", lambda rng: (rng.choice(["push", "push", "push", "take"]), 4, [rng.choice([5, -300, 40_000 if rng.random() < 0.1 else 7]) for _ in range(3)], [1, 2, 3] if rng.random() < 0.9 else [1])),
    "transport": ("command string", lambda rng: (rng.choice(["period", "toggle", "toggle_dry", "skip", "filled", "cover"]),)),
}


@pytest.mark.parametrize("machine", sorted(ROWS))
def test_stream_equals_batch(spark, tmp_path, machine):
    schema, make = ROWS[machine]
    rng = random.Random(machine)
    rows = [(k, s, *make(rng)) for s in range(40) for k in range(5)]
    frame = spark.createDataFrame(rows, f"key long, seq long, {schema}")
    want = sorted(map(tuple, batch(frame, machine).collect()), key=str)
    for part in range(4):
        frame.where(f"seq div 10 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = stream(source, machine).writeStream.format("memory").queryName(f"out_{machine}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    got = sorted(map(tuple, spark.table(f"out_{machine}").collect()), key=str)
    assert got == want


def test_a_feed_takes_whole_frames():
    feed = M.Feed(M.Ring(8))
    assert feed.push([256, 512, -256], [0, 0, 0]) is None
    before = feed.digests
    assert feed.push([1] * 6, [1] * 6) == "space" and feed.push([1], [1, 2]) == "space" and feed.push([1, 40_000], [0, 0]) == "profile"
    assert feed.digests == before and feed.ring.ready == 3
    assert feed.push([512], []) is None and feed.digests[1] == before[1] != feed.digests[0]


@pytest.fixture(scope="module")
def tracks(tmp_path_factory):
    """Two packed tracks and what they hold."""
    from strandline.sources import containers, flac

    folder, rng, signals = tmp_path_factory.mktemp("tracks"), random.Random(5), []
    for name, n in (("a", 300), ("b", 130)):
        x = [rng.randrange(-500, 500) for _ in range(n)]
        signals.append(x)
        data = flac.encode([x, [-v for v in x]], block=64)
        (folder / f"{name}.gafp").write_bytes(containers.pack_flac(data))
        (folder.parent / f"{name}.flac").write_bytes(data)
    return folder, signals


def test_frames_are_read_by_their_offsets(spark, tracks):
    from strandline.streaming import framesource

    framesource.register(spark)
    folder, signals = tracks
    rows = spark.read.format("frames").option("path", str(folder)).option("per_task", "2").load().orderBy("place").collect()
    assert [(r.track, r.frame, r.place, r.roll) for r in rows] == [(0, i, i, i == 0) for i in range(5)] + [(1, i, 5 + i, i == 0) for i in range(3)]
    for t, x in enumerate(signals):
        own = [r for r in rows if r.track == t]
        assert [v for r in own for v in r.left] == x and [-v for r in own for v in r.right] == x and [r.first_sample for r in own] == [64 * i for i in range(len(own))]
    silenced = spark.read.format("frames").option("path", str(folder)).option("skip", "70").load().where("track = 0").orderBy("place").collect()
    assert [v for r in silenced for v in r.left] == [0] * 70 + signals[0][70:]
    one = spark.read.format("frames").option("kind", "flac").option("path", str(folder.parent / "a.flac")).load().orderBy("place").collect()
    assert [v for r in one for v in r.left] == signals[0]


def test_a_stream_pulls_frames_and_rolls_over(spark, tracks, tmp_path):
    import time

    from strandline.streaming import framesource, gate

    framesource.register(spark)
    folder, signals = tracks
    source = spark.readStream.format("frames").option("path", str(folder)).option("per_batch", "3").load()
    query = source.writeStream.format("memory").queryName("pulled").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    for _ in range(300):  # a batch's progress comes after its rows
        progress = list(query.recentProgress)
        if sum(p["numInputRows"] for p in progress) == 8:
            break
        time.sleep(0.2)
    query.stop()
    rows = spark.table("pulled").orderBy("place").collect()
    assert [v for r in rows for v in r.left] == [v for x in signals for v in x] and [r.place for r in rows if r.roll] == [0, 5]
    periods = gate.measured(spark, progress)
    report = gate.report(periods.where("rows > 0"), 60_000).first()
    assert (report.periods, report.starved, report.late, report.most_rows) == (3, 0, 0, 3)
