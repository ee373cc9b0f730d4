"""FLAC reading of known frames, and the writer's round trips."""

import random
from hashlib import sha256

import pytest

from strandline.sources import flac

#: Encoder output, with what it decodes to. Frames of 256 mono samples at 16 bits.
CONSTANT = "fff88808007800000080" + "80"
LPC_WASTED = (
    "fff888080078450fe900dfddcfc7e2a60180522fb372bea1732dbd7ee969480522d1db99f51f12bbb7ef93a900c44a3af33ea1312b9b7ee93e900c54"
    "a3af33ea1352b996ee93e900c54abafbb72931099b6debffc031528ebeedcaf885cdb6f5ffe018c8422fb372be21736dbd7ef8062a948becdcaf885c"
    "4b6f5fba018a8522d1db95f549995ddbf7c9f480422d1db95f549995ddbf7c9f48052251db99f509995ddbf7c01f3d"
)
LPC_WASTED_SAMPLES = "d56ad09a64b1cc8114ad612982c6123533b70d882cae1e8fe75a1aacc3bbd6a4"

INFO = flac.StreamInfo(256, 256, None, None, 32000, 1, 16, None, None)


def test_known_frames_decode():
    head, slots, about, end = flac.frame(bytes.fromhex(CONSTANT), 0, INFO)
    assert slots == [[0] * 256] and about[0]["exit_bit"] == 72 and end == 11 and head.rate == 32000
    head, slots, about, end = flac.frame(bytes.fromhex(LPC_WASTED), 0, INFO)
    assert (about[0]["kind"], about[0]["order"], about[0]["wasted"], about[0]["exit_bit"]) == ("lpc", 3, 5, 1314)
    assert sha256(" ".join(map(str, slots[0])).encode()).hexdigest() == LPC_WASTED_SAMPLES


def test_known_header_fields():
    head = flac.frame_header(bytes.fromhex("fff8b8a80081"), 0, flac.StreamInfo(2048, 2048, None, None, 32000, 2, 16, None, None))
    assert (head.block, head.rate, head.layout, head.bits, head.number, head.size) == (2048, 32000, "mid_side", 16, 0, 6)


def music(n, seed, step=1):
    rng = random.Random(seed)
    x, v = [], 0
    for _ in range(n):
        v = max(-30000, min(30000, v + rng.randint(-900, 900)))
        x.append(v // step * step)
    return x


@pytest.mark.parametrize("layout", ["independent", "left_side", "side_right", "mid_side"])
@pytest.mark.parametrize("lpc", [None, ([29, -17, 5], 4)])
def test_round_trip(layout, lpc):
    left, right = music(1000, 1), music(1000, 2, 8)
    data = flac.encode([left, right], layout=layout, lpc=lpc, seek_every=2)
    rows = list(flac.walk(data))
    assert [x for r in rows for x in r["slots"][0]] == left and [x for r in rows for x in r["slots"][1]] == right
    assert [p[0] for p in flac.seek_points(data)] == [0, 512]


def test_mono_constant_and_noise():
    rng = random.Random(9)
    x = [5] * 256 + [rng.randint(-32768, 32767) for _ in range(256)] + music(77, 3)
    rows = list(flac.walk(flac.encode([x])))
    assert [v for r in rows for v in r["slots"][0]] == x
    assert [r["subframes"][0]["kind"] for r in rows][:2] == ["constant", "verbatim"]


def test_damage_is_refused_or_stepped_over():
    data = bytearray(flac.encode([music(2048, 4)]))
    whole = list(flac.walk(bytes(data)))
    data[whole[3]["offset"] + 20] ^= 64
    with pytest.raises(ValueError):
        list(flac.walk(bytes(data)))
    found = list(flac.walk(bytes(data), resync=True))
    good = [r["head"].number for r in found if not r["error"]]
    assert good == [n for n in range(8) if n != 3] and sum(bool(r["error"]) for r in found) >= 1


@pytest.mark.parametrize("value", [0, 127, 128, 2047, 2048, 65535, 65536, (1 << 21) - 1, 1 << 21, (1 << 31) - 1, 1 << 31, (1 << 36) - 1])
def test_coded_numbers(value):
    raw = flac.number_bytes(value)
    assert flac.coded_number(flac.Bits(raw)) == value


def test_longer_forms_are_refused():
    for raw in (b"\xc1\x81", b"\xe0\x9f\xbf", b"\xf0\x8f\xbf\xbf", b"\x80", b"\xff", b"\xc2\x41"):
        with pytest.raises(ValueError):
            flac.coded_number(flac.Bits(raw))


def test_tables(spark):
    left, right = music(600, 5), music(600, 6)
    files = spark.createDataFrame([("a", bytearray(flac.encode([left, right], layout="mid_side", seek_every=1))), ("b", bytearray(flac.encode([left]))), ("c", bytearray(b"junk"))], "path string, content binary")
    good = files.where("path <> 'c'")
    blocks = flac.read_blocks(good).collect()
    assert [(r.path, r.name, r.last) for r in blocks] == [("a", "streaminfo", False), ("a", "seektable", True), ("b", "streaminfo", True)]
    streams = {r.path: r for r in flac.read_streams(files, strict=False).collect()}
    assert (streams["a"].samples, streams["a"].channels, streams["b"].channels, streams["c"].error) == (600, 2, 1, "no fLaC marker")
    assert [r.first_sample for r in flac.read_seek_points(good).collect()] == [0, 256, 512]
    frames = flac.read_frames(good)
    samples = {(r.path, r.i): (r.left, r.right) for r in flac.pcm(frames).collect()}
    assert samples == {("a", i): (left[i], right[i]) for i in range(600)} | {("b", i): (left[i], left[i]) for i in range(600)}
    assert sum(r.n for r in flac.subframe_census(frames).collect()) == 9
    with pytest.raises(Exception, match="no fLaC marker"):
        flac.read_streams(files).collect()


def test_lenient_headers_find_frames_without_a_tail_and_strict_ones_no_others():
    import random

    from strandline.sources import scan

    rng = random.Random(2)
    x = [rng.randrange(-3000, 3000) for _ in range(256 * 9)]
    data = flac.encode([x], block=256)
    info, start = flac.facts(data)
    at = scan.sync_shapes(data, start).tolist()
    frames = [r["offset"] for r in flac.walk(data)]
    assert [i for i in at if scan.strict_header(data, i, info)] == frames and set(frames) <= {i for i in at if scan.lenient_header(data, i)}
    assert not scan.lenient_header(data, frames[1] + 1) and not scan.lenient_header(b"\xff\xf8", 0)
    assert scan.header_at_bit(data, 8 * frames[2], info).number == 2 and scan.header_at_bit(data, 8 * frames[2] + 3, info) is None


def test_rice_kernels_agree_on_values_and_place():
    import random

    from strandline.sources import rice
    from strandline.sources.bitio import Bits, BitWriter, Short

    rng = random.Random(11)
    for _ in range(200):
        k, n, lead = rng.randrange(0, 15), rng.choice([0, 1, 5, 300]), rng.randrange(0, 9)
        w = BitWriter()
        w.put(0, lead)
        want = [rng.randrange(-(1 << k + 2), 1 << k + 2) if rng.random() < 0.98 else rng.randrange(-(1 << k + 9), 1 << k + 9) for _ in range(n)]
        for v in want:
            z = 2 * v if v >= 0 else -2 * v - 1
            w.unary(z >> k)
            if k:
                w.put(z, k)
        data = w.bytes() + bytes([0x81] * rng.randrange(0, 3))
        places = []
        for kernel in rice.KERNELS.values():
            b = Bits(data)
            b.at = lead
            assert kernel(b, n, k) == want
            places.append(b.at)
        assert len(set(places)) == 1
    for kernel in rice.KERNELS.values():
        with pytest.raises(Short):
            kernel(Bits(bytes(40)), 3, 2)
        w = BitWriter()
        w.unary(1 << 18)
        w.put(0, 14)
        with pytest.raises(rice.RiceError):
            kernel(Bits(w.bytes() + bytes(8)), 1, 14)


def test_many_blocks_integrate_as_one_at_a_time():
    import random

    import numpy as np

    from strandline.operators.predict import integrate_lpc_blocks, integrate_lpc_samples

    rng = random.Random(12)
    for bits in (None, 32):
        weights = [rng.randrange(-40, 40) for _ in range(4)]
        blocks = [[rng.randrange(-9000, 9000) for _ in range(rng.choice([0, 2, 4, 40]))] for _ in range(30)]
        got = integrate_lpc_blocks([np.array(b, np.int64) for b in blocks], weights, 5, bits)
        assert [g.tolist() for g in got] == [integrate_lpc_samples(b, weights, 5, bits) for b in blocks]
