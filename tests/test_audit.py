"""Audits find what was planted, digests refuse whole frames, profiles refuse before anything is encoded."""

import os
import random

import pytest

from strandline.functions.digest import FNV64, fnv_of
from strandline.session import replace_file, scratch_path
from strandline.sources import audit, containers, flac, wav


@pytest.fixture(scope="module")
def stream():
    rng = random.Random(4)
    left = [round(4000 * rng.random()) for _ in range(300)]
    return flac.encode([left, [v // 2 for v in left]], block=64, layout="left_side", seek_every=1)


def test_every_planted_fault_of_a_container_is_named(stream):
    blob = containers.pack_flac(stream)
    assert audit.gafp_problems(blob, stream) == []
    for at, want in ((4, "version"), (5, "channels or bits"), (8, "block size"), (10, "rate"), (14, "samples"), (22, "frame count"), (24, "frame data offset"), (32, "slice 0: size")):
        changed = bytearray(blob)
        changed[at] ^= 1
        assert want in audit.gafp_problems(bytes(changed), stream)
    assert "slice 4: size" in audit.gafp_problems(blob + b"\0", stream) and audit.gafp_problems(b"GAFP", stream)


def test_a_stream_is_held_against_itself(stream):
    assert audit.stream_problems(stream) == [] and audit.stream_problems(b"RIFF")[0].startswith("metadata")
    frames = list(flac.walk(stream))
    damaged = bytearray(stream)
    damaged[frames[2]["offset"] + 9] ^= 4
    found = audit.stream_problems(bytes(damaged))
    assert any(p.startswith("frame 2") for p in found) and any("declared" in p for p in found) and any(p.startswith("seek point 2") for p in found)


def test_digests_fold_whole_frames_or_nothing():
    left, right = [1, -2, 300], [-32768, 32767, 0]
    whole = audit.pcm_digest(left, right)
    assert whole == audit.pcm_digest(left[1:], right[1:], audit.pcm_digest(left[:1], right[:1])) == fnv_of(audit.stereo_bytes(left, right), *FNV64, 64)
    assert audit.played_digests(left, None)[1] == FNV64[0]
    for fold in (audit.pcm_digest, audit.played_digests):
        with pytest.raises(ValueError, match="40000"):
            fold([1, 40000], [0, 0])


def test_profiles_refuse(spark):
    assert audit.profile_faults(audit.PROFILE) == [] and audit.profile_faults(audit.PROFILE | {"rates": (44100,), "max_order": 5, "blocks": ()}) == ["rates", "blocks", "max_order"]
    blobs = spark.createDataFrame([("a", 2048, 16384, 2, 0), ("b", 4096, 32000, 2, 1), ("c", None, 16384, 3, 0)], "path string, block int, rate int, channels int, max_order int")
    assert {r.path: r.reasons for r in audit.profile_verdict(blobs, audit.PROFILE).collect()} == {"a": [], "b": ["rate", "block", "order"], "c": ["block", "channels"]}
    with pytest.raises(ValueError, match="can't be met"):
        audit.profile_verdict(blobs, audit.PROFILE | {"bits": (24,)})
    rows = [(0, 445558, 2097152, 21.246, 2048, 16384), (1, 445558, 2097152, 25.0, 2048, 16384), (2, 445558, 2000000, 22.2779, 2048, 16384)]
    assert {r.id: r.reasons for r in audit.measured_faults(spark.createDataFrame(rows, "id int, cycles long, budget long, percent double, block int, rate int")).collect()} == {1: ["percent"], 2: ["budget"]}


def test_every_rate_but_the_product_s_is_refused(spark):
    rates = (8000, 8192, 11025, 16000, 22050, 24000, 32000, 32768, 44100, 48000, 65536, 16384)
    blobs = spark.createDataFrame([(str(r), 2048, r, 2, 0) for r in rates], "path string, block int, rate int, channels int, max_order int")
    assert {r.path for r in audit.profile_verdict(blobs, audit.PROFILE).where("size(reasons) = 0").collect()} == {"16384"}


def test_tags_and_small_writers(spark, stream):
    tagged = flac.with_comments(stream, {"Title": "One", "ARTIST": "É", "title": "Two"})
    assert flac.comments(tagged) == {"title": "One", "artist": "É"} and flac.comments(stream) == {}
    assert [r["slots"] for r in flac.walk(tagged)] == [r["slots"] for r in flac.walk(stream)]
    files = spark.createDataFrame([("/x/one.flac", bytearray(tagged)), ("/x/two.b.flac", bytearray(stream))], "path string, content binary")
    assert {(r.title, r.artist) for r in flac.read_tags(files).collect()} == {("One", "É"), ("two.b", "?")}
    assert wav.pair_bytes([1.0, 2.0], [-1.0, 0.5]) == b"".join(x for x in (b"\0\0\x80?", b"\0\0\x80\xbf", b"\0\0\0@", b"\0\0\0?"))


def test_a_file_is_replaced_whole(spark):
    path = scratch_path(spark, "one.bin")
    for data in (b"a" * 3_000_000, b"", b"second"):
        replace_file(spark, path, data)
        local = path.removeprefix("file:")
        assert open(local, "rb").read() == data
        assert [n for n in os.listdir(os.path.dirname(local)) if n.endswith(".part")] == []


def test_scratch_goes_with_its_scope(spark):
    from strandline import session

    kept = session.materialize(spark.range(3), "kept")
    with session.scratch_scope(spark):
        gone = session.materialize(spark.range(4), "gone")
        inside = gone.scratch.removeprefix("file:")
        assert gone.count() == 4 and os.path.exists(inside)
    assert not os.path.exists(inside) and kept.count() == 3
    session.forget(kept)
    assert not os.path.exists(kept.scratch.removeprefix("file:"))
