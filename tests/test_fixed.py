"""Fixed-point synthesis against the floating transform, and joins of segments."""

import numpy as np

from strandline.operators import fixed, transform


def test_tables_follow_their_rules():
    t = fixed.tables()
    assert [int(x) for x in fixed.steps()[[0, 8, 160, 191]]] == [1, 2, 1 << 20, 15384775]
    assert sorted(t["order"][0]) == list(range(256)) and list(t["order"][0][:5]) == [0, 64, 128, 192, 16]
    assert (int(t["before"][0][0]), int(t["before"][1][0])) == (2147481121, -3294197)
    assert (int(t["after"][0][0]), int(t["after"][1][1])) == (2147483647, -13176712)
    assert [int(x) for x in t["window"][0][[0, 511]]] == [1647099, 1073740561]


def test_transform_is_the_floating_one_scaled():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 26), 1 << 26, (5, 512))
    got = fixed.imdct(x)
    want = transform.dct4(x.astype(float))
    scale = (got * want).sum() / (want * want).sum()
    assert np.abs(got - scale * want).max() < 16 and scale > 0


def test_synthesis_of_segments_joins_without_a_seam():
    rng = np.random.default_rng(2)
    frames = [{"g": 100, "ms": int(rng.integers(2)), "channels": [[(3, [int(v) for v in rng.integers(-9, 10, 16)]) for _ in range(6)] for _ in range(2)]} for _ in range(9)]
    offsets = [[0] + [3] * 15] * 4
    eight, sixteen, _ = fixed.synthesise(frames, offsets)
    first, first16, tails = fixed.synthesise(frames[:4], offsets)
    rest, rest16, _ = fixed.synthesise(frames[4:], offsets, tails)
    assert np.array_equal(np.concatenate([first, rest], 1), eight) and np.array_equal(np.concatenate([first16, rest16], 1), sixteen)
    assert np.abs(sixteen).max() > 50


def test_overlap_gives_a_signal_back():
    """Coefficients of a real signal, rounded at a fine scale, come back as the signal."""
    rng = np.random.default_rng(3)
    hop = 512
    s = np.cumsum(rng.normal(0, 60, hop * 6)).clip(-20000, 20000)
    padded = np.concatenate([np.zeros(hop), s, np.zeros(hop)])
    frames = np.stack([padded[i * hop : (i + 2) * hop] for i in range(7)]) * transform.sine_window(hop)
    c = transform.mdct(frames)
    _, trial, _ = fixed.overlap(fixed.imdct(np.round(c * 256).astype(np.int64)))
    out = trial.ravel()[hop:].astype(float)
    gain = (out * s).sum() / (s * s).sum()
    assert abs(gain) > 0.01 and np.corrcoef(out, s)[0, 1] ** 2 > 0.99
