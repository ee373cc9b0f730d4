"""The lossy codec: budget, quality, exact symbols, and the search against enumeration."""

import numpy as np
import pytest

from strandline.operators import codec, fixed
from strandline.sources import containers, uli


@pytest.fixture(scope="module")
def music():
    rng = np.random.default_rng(5)
    i = np.arange(512 * 8)
    left = 9000 * np.sin(i * 0.031) + 3000 * np.sin(i * 0.21) + rng.normal(0, 40, len(i))
    return np.round(np.stack([left, 0.8 * left + rng.normal(0, 60, len(i))]))


TRACKS = [{"start_sample": 0, "samples": 2000, "title": "One", "artist": "A"}, {"start_sample": 2000, "samples": 2096, "title": "Two", "artist": "A"}]


@pytest.fixture(scope="module")
def rows(spark, music):
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(music.T)], "i long, left double, right double")


def test_encode_meets_its_budget_and_more_bits_sound_better(rows, music):
    found = []
    for bits in (2500, 9000):
        blob = codec.encode(rows, music.shape[1], bits, TRACKS)
        m = containers.parse_ula2(blob)
        assert m["header"]["frames"] == 9 and m["tracks"][1]["preroll_frame"] == 3 and m["header"]["most_cycles"] >= m["header"]["mean_cycles"] > 155_000
        frames = list(uli.read_frames(m["stream"], uli.Tables.parse(m["tables"]), 0, 0, 9))
        assert sum(f["bits"] for f in frames) <= bits
        found.append(codec.snr(music, codec.decode(blob).astype(float)))
    assert found[0] > 8 and found[1] > found[0] + 3


def test_the_second_sweep_and_trained_tables_sound_no_worse(rows, music):
    heard = [codec.snr(music, codec.decode(codec.encode(rows, music.shape[1], 2500, TRACKS, width=w, train=t)).astype(float)) for w, t in ((0, False), (6, False), (6, True))]
    assert heard[1] >= heard[0] - 0.05 and heard[2] >= heard[1] - 0.05 and heard[2] > heard[0]


def test_a_track_is_entered_by_its_preroll(rows, music):
    blob = codec.quantise_all(rows, music.shape[1], 90, TRACKS)
    whole = codec.decode(blob)
    assert whole.shape[1] == music.shape[1]
    for i, t in enumerate(TRACKS):
        assert np.array_equal(codec.decode_track(blob, i), whole[:, t["start_sample"] : t["start_sample"] + t["samples"]])


def test_class_path_is_the_cheapest_of_all():
    """Every path of the first bands and every end, enumerated; the price of a channel is what the writer takes."""
    from itertools import product

    t = uli.Tables.default()
    rng = np.random.default_rng(9)
    x = np.zeros(512)
    x[:32] = rng.normal(0, 900, 32)
    step, lam = 20, codec.price(20)
    cost, bits, mags = codec.class_choices(x, t, step, lam)

    def total(bands):
        back = fixed.dequantise(bands, t.offsets, step)
        return np.square(x - back)[: uli.CODED].sum() + lam * codec.frame_bits(t, [bands])[1]

    best = codec.best_channel(x, t, step, lam)
    tried = [[]] + [[(c, (mags[c, 16 * b : 16 * b + 16] * np.sign(x[16 * b : 16 * b + 16])).astype(int).tolist()) for b, c in enumerate(path)] for n in (1, 2) for path in product(range(8), repeat=n) if all(np.isfinite(cost[b, c]) for b, c in enumerate(path))]
    assert total(best) <= min(map(total, tried)) + 1e-6
    for c in (1, 3, 9):
        want = codec.band_choice(x[:16], t, c, step, lam)
        assert (want is None) == (not np.isfinite(cost[0, c])) and (want is None or abs(want[1] + lam * want[2] - cost[0, c]) < 1e-6)


def test_counted_bits_are_the_written_ones():
    rng = np.random.default_rng(10)
    t = uli.Tables.default()
    for step in (9, 40, 300, 5000):
        for x in (rng.normal(0, 3e4, 512), rng.normal(0, 200, 512) * (np.arange(512) < 100), np.zeros(512)):
            for bands in (codec.quantise_channel(x, t, step), codec.best_channel(x, t, step, codec.price(step))):
                assert codec.channel_bits(t, bands) == codec.frame_bits(t, [bands])[1]


def test_plans_refuse_with_both_numbers():
    tables = uli.Tables.default().blob()
    p = codec.plan(44_100, TRACKS, 200_000, tables)
    assert p["frames"] == 88 and p["seeks"] == 1 and p["bits"] == (200_000 - p["overhead"]) * 8 - 64
    with pytest.raises(codec.BudgetError) as error:
        codec.plan(44_100, TRACKS, 1000, tables)
    assert error.value.allowed == 1000 and error.value.needed == p["overhead"]


def test_joined_bits_equal_one_string():
    import random

    rng = random.Random(3)
    parts = ["".join(rng.choice("01") for _ in range(rng.choice([0, 1, 7, 8, 9, 300]))) for _ in range(40)]
    raw, starts = codec.join_bits([(len(p), int(p.ljust(-(-len(p) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(p) // 8), "big")) for p in parts])
    whole = "".join(parts)
    assert bin(int.from_bytes(b"\1" + raw, "big"))[3:][: len(whole)] == whole and starts == [sum(map(len, parts[:i])) for i in range(40)]


def test_quantiser_is_nearest_and_classes_have_headroom(music):
    t = uli.Tables.default()
    x = np.random.default_rng(6).normal(0, 3e6, 512)
    step = int(fixed.steps()[120])
    bands = codec.quantise_channel(x, t, step)
    back = fixed.dequantise(bands, t.offsets, step)[: uli.CODED]
    for m in range(0, 40):
        rec = 0 if m == 0 else (16 * m - 3) * step
        assert (np.abs(np.abs(x[: uli.CODED]) - np.abs(back)) <= np.abs(np.abs(x[: uli.CODED]) - rec) + 1e-6).all()


def test_band_search_finds_the_cheapest_choice():
    from itertools import product

    t = uli.Tables.default()
    rng = np.random.default_rng(7)
    for c in (1, 3):
        x = rng.normal(0, 400, 4)
        step, lam = 12, 900.0
        m, dist, bits = codec.band_choice(x, t, c, step, lam)
        best = min(
            sum((abs(v) - (16 * k - t.offsets[c][min(k, 15)] if k else 0) * step) ** 2 for v, k in zip(x, ks, strict=True)) + lam * cost(t, c, ks)
            for ks in product(range(4), repeat=4)
            if all(k in (0, int(abs(v) / (16 * step)), int(abs(v) / (16 * step)) + 1) for v, k in zip(x, ks, strict=True))
        )
        assert abs(dist + lam * bits - best) < 1e-6 and all(a * v >= 0 for a, v in zip(m, x, strict=True))


def cost(t, c, ks):
    """Bits the writer takes for one band of these magnitudes and zeros after them, less the class symbol and those zeros."""
    from strandline.sources.bitio import BitWriter

    def size(m):
        w = BitWriter()
        uli.write_channel(w, t, [(c, m)] * 1)
        return len(w.done) * 8 + w.n

    per = 2 if t.types[c] == uli.PAIR else 4
    zeros = t.books[c].lengths[0] * (16 // per)
    return size([*ks, *[0] * 12]) - size([0] * 16) + zeros - t.books[c].lengths[0] * (12 // per)


def test_code_tables_are_made_once_and_stay_apart(monkeypatch):
    """A thousand tables of the same codes build no book again, and what is changed in one isn't in another."""
    blob = uli.Tables.parse(uli.Tables.default().blob()).blob()
    made = []
    build = uli.Book.__post_init__
    monkeypatch.setattr(uli.Book, "__post_init__", lambda self: (made.append(1), build(self))[1])
    for i in range(1000):
        t = uli.Tables.parse(uli.Tables.default().blob())
        if i % 2:
            t.raw[2], t.offsets[5][1], t.contexts[0], t.books[1] = 1, 16, uli.Book([1] + [0] * 14), uli.Book([1] + [0] * 80)
        assert [v[:2] for v in t.violations()] == ([(1, "code"), (2, "raw"), (5, "offset"), (14, "context")] if i % 2 else [])
    assert len(made) == 1000 and uli.Tables.default().blob() == blob


def test_albums_are_decoded_by_tasks_as_in_one_piece(spark):
    """Two albums of different lengths over several seek entries, whole and by their tracks, in pieces that cross entries."""
    rng = np.random.default_rng(12)
    t, blobs, rows = uli.Tables.default(), {}, {}
    for path, frames, last in (("long", 600, 100), ("short", 3, 512)):
        n = (frames - 2) * 512 + last
        found = [{"g": int(g), "ms": int(ms), "channels": [[(6, rng.integers(-9, 10, 16).tolist()) for _ in range(3)] for _ in range(2)]} for g, ms in zip(rng.integers(90, 100, frames), rng.integers(0, 2, frames), strict=True)]
        stream, places = uli.write_frames(found, t)
        cut = n * 2 // 3
        rows[path] = [{"start_sample": a, "samples": b - a, "preroll_frame": a // 512, "skip": a % 512, "title": "t", "artist": "a"} for a, b in ((0, cut), (cut, n))]
        blobs[path] = containers.build_ula2(rows[path], places, t.blob(), stream, n)
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "path string, content binary")
    for track, size in ((None, 256), (None, 100), (0, 256), (1, 256), (1, 77)):
        got = codec.decoded(files, track, size).toPandas().sort_values(["path", "i"])
        for path, blob in blobs.items():
            want = codec.decode(blob) if track is None else codec.decode_track(blob, track)
            own = got[got["path"] == path]
            assert own["i"].tolist() == list(range(want.shape[1])) and np.array_equal(own[["left", "right"]].to_numpy().T, want)


def test_the_album_query_brings_no_samples_to_the_driver(spark, sf, monkeypatch):
    """What is decoded in the driver grows with the album; tasks decode, and the driver gets sums."""
    from pyspark.sql import DataFrame

    from strandline.plans import registry

    def refuse(*_, **__):
        raise AssertionError("samples in the driver")

    for owner, name in ((codec, "decode"), (codec, "decode_track"), (DataFrame, "toPandas"), (type(spark.range(1)), "toPandas")):
        monkeypatch.setattr(owner, name, refuse)
    assert tuple(registry.QUERIES["album_codec"](spark, sf).first())[3:] == (2, True, True, True)
