"""Containers, WAV, Ogg and symbol streams: round trips and refusals."""

import random
import struct

import numpy as np
import pytest

from strandline.sources import containers as C
from strandline.sources import flac, ogg, uli, wav


def music(n, seed):
    rng, v, out = random.Random(seed), 0, []
    for _ in range(n):
        v = max(-30000, min(30000, v + rng.randint(-500, 500)))
        out.append(v)
    return out


def test_gafp_round_trip_and_seek():
    x = music(1000, 1)
    blob = C.pack_flac(flac.encode([x]))
    assert C.parse_gafp(blob)["samples"] == 1000
    assert [v for _, s in C.decode_gafp(blob) for v in s[0]] == x
    assert [v for _, s in C.decode_gafp(blob, 2) for v in s[0]] == x[512:]


@pytest.mark.parametrize("at", [0, 4, 5, 6, 7, 24, 28])
def test_gafp_refusals(at):
    blob = bytearray(C.pack_flac(flac.encode([music(600, 2)])))
    blob[at] ^= 0x55
    with pytest.raises(C.ContainerError):
        C.parse_gafp(bytes(blob))


def frames_of(n, seed, tables):
    rng, out, g = random.Random(seed), [], 90
    for _ in range(n):
        g = max(8, min(187, g + rng.randint(-3, 3)))
        channels = []
        for _ in range(2):
            bands = []
            for _ in range(rng.choice([0, 3, 20, 32])):
                c = rng.randrange(len(tables.types))
                most = {uli.ZERO: 0, uli.QUAD: 4, uli.PAIR: 20 << tables.raw[c]}[tables.types[c]]
                bands.append((c, [rng.randint(-most, most) if rng.random() < 0.6 else 0 for _ in range(16)]))
            channels.append(bands)
        out.append({"g": g, "ms": rng.randint(0, 1), "channels": channels})
    return out


@pytest.fixture(scope="module")
def album():
    tables = uli.Tables.default()
    frames = frames_of(300, 4, tables)
    stream, places = uli.write_frames(frames, tables)
    tracks = [{"start_sample": 0, "samples": 100_000, "preroll_frame": 0, "skip": 0, "title": "One", "artist": "Ä"}, {"start_sample": 100_000, "samples": 53_000, "preroll_frame": 195, "skip": 160, "title": "Two", "artist": "Ä"}]
    return tables, frames, places, C.build_ula2(tracks, places, tables.blob(), stream, 153_000)


def test_tables_round_trip(album):
    tables = album[0]
    again = uli.Tables.parse(tables.blob())
    assert again.blob() == tables.blob() and again.census() == {"zero": 1, "quad": 2, "pair": 11, "max_raw": 5, "max_escape": 0}
    for book in [*tables.contexts, *(b for b in tables.books if b)]:
        assert abs(sum(2.0**-n for n in book.lengths) - 1) < 1e-9


def test_symbols_round_trip_and_seek(album):
    tables, frames, places, blob = album
    m = C.parse_ula2(blob)
    found = list(uli.read_frames(m["stream"], tables, 0, 0, 300))
    assert [(f["g"], f["ms"], f["channels"]) for f in found] == [(f["g"], f["ms"], [[(c, v if tables.types[c] else [0] * 16) for c, v in ch] for ch in f["channels"]]) for f in frames]
    assert [(f["bitpos"]) for f in found] == [p for p, _ in places]
    s = m["seeks"][1]
    assert [f["g"] for f in uli.read_frames(m["stream"], tables, s["bitpos"], s["g_prev"], 44)] == [f["g"] for f in frames[256:]]


def test_ula2_tables_in_spark(spark, album):
    _, frames, places, blob = album
    files = spark.createDataFrame([("a", bytearray(blob)), ("b", bytearray(b"junk"))], "path string, content binary")
    rows = C.read(files, "ula2", strict=False).collect()
    assert [(r.title, r.artist, r.bitpos, r.error) for r in rows if r.path == "a"] == [("One", "Ä", 0, None), ("Two", "Ä", places[195][0], None)]
    assert [r.error for r in rows if r.path == "b"] == ["shorter than its header"]
    got = uli.read_symbols(files.where("path = 'a'")).orderBy("frame").collect()
    assert [(r.frame, r.g, r.bitpos) for r in got] == [(i, f["g"], places[i][0]) for i, f in enumerate(frames)]
    assert uli.cycles(uli.read_symbols(files.where("path = 'a'"))).where("cycles is null").count() == 0


@pytest.mark.parametrize("field", [0, 4, 8, 12, 24, 28, 40, 44, 52, 60, 64])
def test_ula2_refusals(album, field):
    blob = bytearray(album[3])
    struct.pack_into("<I", blob, field, 0x7FFFFFF1)
    with pytest.raises(C.ContainerError):
        C.parse_ula2(bytes(blob))


def test_albm_round_trip_shares_assets_and_strings():
    tracks = [{"samples": 16384 * (i + 1), "title": f"T{i % 2}", "artist": "Same", "asset": b"abc" * 9 if i != 1 else b"z" * 8} for i in range(3)]
    blob = C.build_albm("Album", "Same", 1999, tracks)
    m = C.parse_albm(blob)
    assert (m["title"], m["artist"], m["year"], m["assets_ok"], len(m["assets"])) == ("Album", "Same", 1999, True, 35)
    assert [(t["title"], t["start_sample"], t["asset_off"]) for t in m["tracks"]] == [("T0", 0, 0), ("T1", 16384, 27), ("T0", 49152, 0)]
    assert m["tracks"][0]["title_off"] == m["tracks"][2]["title_off"]
    for at in (7, 8, 12, 54, 64, 68, 72, 80, 90, 100):
        bad = bytearray(blob)
        bad[at] ^= 0x41
        with pytest.raises((C.ContainerError, UnicodeDecodeError)):
            C.parse_albm(bytes(bad))
    bad = bytearray(blob)
    bad[-1] ^= 1
    assert not C.parse_albm(bytes(bad))["assets_ok"]


def test_art1_round_trip(spark):
    pixels = [[(x // 3 + y // 5) % 11 * 700 for x in range(24)] for y in range(16)]
    blob = C.build_art1(pixels, 3)
    assert C.parse_art1(blob)["pixels"] == pixels
    got = C.read(spark.createDataFrame([("p", bytearray(blob))], "path string, content binary"), "art1").collect()
    assert {(r.y, r.x): r.colour for r in got} == {(y, x): c for y, row in enumerate(pixels) for x, c in enumerate(row)}
    with pytest.raises(C.ContainerError):
        C.build_art1([[x + 8 * y for x in range(8)] for y in range(8)])
    bad = bytearray(blob)
    bad[100] ^= 1
    with pytest.raises(C.ContainerError):
        C.parse_art1(bytes(bad))


def test_wav_round_trip_depths_and_tags(spark):
    x = np.array([music(500, 7), music(500, 8)]).T
    data = wav.build(x, 22050, {"title": "Tïtle", "artist": "A"})
    w = wav.parse(data)
    assert (w["rate"], w["channels"], w["tags"]) == (22050, 2, {"title": "Tïtle", "artist": "A"}) and np.array_equal(w["samples"], x)
    for kind, bits, raw in ((1, 8, bytes([0, 128, 255])), (1, 24, b"\0\0\x80\0\0\0\xff\xff\x7f"), (1, 32, struct.pack("<3i", -(1 << 31), 0, (1 << 31) - 1)), (3, 32, struct.pack("<3f", -1, 0, 0.5))):
        head = b"fmt " + struct.pack("<IHHIIHH", 16, kind, 1, 8000, 8000 * bits // 8, bits // 8, bits)
        body = head + b"data" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
        got = wav.parse(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)["samples"][:, 0]
        assert got[0] == -32768 and got[1] == 0
    files = spark.createDataFrame([("d/song.wav", bytearray(wav.build(x[:, :1], 8000))), ("bad", bytearray(b"RIFF"))], "path string, content binary")
    rows = wav.read(files, rows=200, strict=False).collect()
    assert [r.start for r in rows if r.path != "bad"] == [0, 200, 400] and {r.title for r in rows if r.path != "bad"} == {"song"}
    got = {r.i: (r.left, r.right) for r in wav.samples(wav.read(files, rows=200, strict=False)).collect()}
    assert got == {i: (v, v) for i, v in enumerate(x[:, 0].astype(float))}


@pytest.mark.parametrize("cut", [3, 20, 40, 50])
def test_wav_refusals(cut):
    with pytest.raises(wav.WavError):
        wav.parse(wav.build(np.array([[1, 2]] * 9), 8000)[:cut])


def test_track_lists(spark, tmp_path):
    (tmp_path / "tracks.tsv").write_text('# n\tstart\n1\t0\t100\tA "quoted"\tX\n2\t100\t50\tB\tY\n4\t120\t0\tC\tZ\n')
    t = wav.read_tracks(spark, str(tmp_path / "tracks.tsv"))
    assert [(r.n, r.title) for r in t.orderBy("n").collect()] == [(1, 'A "quoted"'), (2, "B"), (4, "C")]
    assert {r.n: r.reasons for r in wav.track_faults(t).collect()} == {4: ["number", "overlap", "empty"]}
    wav.write_tracks(t.where("n < 3"), str(tmp_path / "out"))
    assert sorted(r.title for r in wav.read_tracks(spark, str(tmp_path / "out")).collect()) == ['A "quoted"', "B"]


def test_ogg_packets_cross_pages(spark):
    one, two = bytes(range(256)) * 2, b"tail"
    data = ogg.build_page(0, one[:255], bytes([255]), 2) + ogg.build_page(1, one[255:] + two, bytes([255, 2, 4]), 1)
    assert list(ogg.packets(data)) == [(0, one), (1, two)]
    bad = bytearray(data)
    bad[40] ^= 1
    for broken, why in ((bytes(bad), "CRC"), (data[:-1], "cut off"), (data + ogg.build_page(5, b"x", b"\1"), "follows")):
        with pytest.raises(ValueError, match=why):
            list(ogg.packets(broken))
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(bytes(bad)))], "path string, content binary")
    rows = ogg.read_packets(files, strict=False).collect()
    assert [(r.packet, r.page, len(r.data)) for r in rows if r.path == "a"] == [(0, 0, 512), (1, 1, 4)] and [r.error for r in rows if r.path == "b"][0]
    assert ogg.opus_head(b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, 48000, 0, 0))["pre_skip"] == 312
