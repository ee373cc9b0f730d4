"""Containers over the driver's tables: rows are packed into files, the files are read back, SQL has the rows."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.bits import fits16
from strandline.functions.digest import FNV64
from strandline.plans.q_predict import SIGNAL_SQL, signal
from strandline.plans.registry import query
from strandline.session import table
from strandline.sources import audit, containers, flac, ogg, scan, uli, wav

#: Users' signals at half scale, so that they fit 16 bits.
_HALF_SQL = f"SELECT user_id, n, x // 2 AS x FROM ({SIGNAL_SQL})"


def _files(spark, sf, build):
    """path, content: one file a user. A user's signal is one stream, so it is one row."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = signal(spark, sf).select("user_id", (F.row_number().over(w) - 1).alias("n"), F.expr("x div 2").alias("x"))
    rows = s.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s")).select("user_id", F.col("s.x").alias("x"))

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([build([int(v) for v in x]) for x in values])

    return rows.select(F.col("user_id").cast("string").alias("path"), run("x").alias("content"))


def _flac(x: list[int]) -> bytes:
    return flac.encode([x, [-v for v in x]], block=32, layout="mid_side", seek_every=2)


def _flac_whole(x: list[int]) -> bytes:
    """The same at the depth that a signal beyond 16 bits needs: a frame's first samples are written plainly."""
    most = max(max(x), -min(x))
    return flac.encode([x, [-v for v in x]], bits=next((b for b in (16, 24) if most < 1 << b - 1), 32), block=32, layout="mid_side", seek_every=2)


def _user():
    return F.col("path").cast("long").alias("user_id")


@query("flac_samples", f"SELECT user_id, n AS i, x::INT AS \"left\", (-x)::INT AS \"right\" FROM ({_HALF_SQL})")
def flac_samples(spark, sf):
    return flac.pcm(flac.read_frames(_files(spark, sf, _flac_whole))).select(_user(), "i", "left", "right")


@query("flac_frames", f"SELECT user_id, f::INT AS frame, f AS number, least(32, n - 32 * f)::INT AS block, 2 AS channels FROM (SELECT user_id, count(*) AS n, unnest(range(0, (count(*) + 31) // 32)) AS f FROM ({_HALF_SQL}) GROUP BY user_id)")
def flac_frames(spark, sf):
    return flac.read_frames(_files(spark, sf, _flac)).select(_user(), "frame", "number", "block", "channels")


@query("flac_streams", f"SELECT user_id, count(*) AS samples, 16384 AS rate, 2 AS channels, 16 AS bits FROM ({_HALF_SQL}) GROUP BY user_id")
def flac_streams(spark, sf):
    return flac.read_streams(_files(spark, sf, _flac)).select(_user(), "samples", "rate", "channels", "bits")


@query("flac_blocks", f"SELECT user_id, unnest(['streaminfo', 'seektable']) AS name, unnest([34, 18 * (((count(*) + 31) // 32 + 1) // 2)]) AS length FROM ({_HALF_SQL}) GROUP BY user_id")
def flac_blocks(spark, sf):
    return flac.read_blocks(_files(spark, sf, _flac)).select(_user(), "name", "length")


@query("flac_seek_points", f"SELECT user_id, (k // 2)::INT AS idx, 32 * k AS first_sample FROM (SELECT user_id, unnest(range(0, (count(*) + 31) // 32, 2)) AS k FROM ({_HALF_SQL}) GROUP BY user_id)")
def flac_seek_points(spark, sf):
    return flac.read_seek_points(_files(spark, sf, _flac)).select(_user(), "idx", "first_sample")


_CENSUS_SQL = f"""
    WITH s AS (SELECT user_id, n // 32 AS blk, n % 32 AS i, 2 * x AS v FROM ({_HALF_SQL})), w AS (SELECT user_id, blk, count(*) AS len, bit_or(v) AS m, count(DISTINCT v) AS kinds FROM s GROUP BY ALL),
    z AS (SELECT s.user_id, s.blk, i, len, kinds, CASE WHEN m = 0 THEN 0 ELSE bit_count((m & -m) - 1) END AS wasted, v FROM s JOIN w ON w.user_id = s.user_id AND w.blk = s.blk), y AS (SELECT *, v >> wasted AS x FROM z),
    e AS ({" UNION ALL ".join(f"SELECT user_id, blk, {o} AS ord, x {' '.join(f'- ({c}) * lag(x, {k}) OVER q' for k, c in enumerate(flac.FIXED[o], 1))} AS e, i, len, kinds, wasted FROM y WINDOW q AS (PARTITION BY user_id, blk ORDER BY i)" for o in range(5))}),
    c AS (SELECT user_id, blk, ord, k, any_value(len) AS len, any_value(kinds) AS kinds, any_value(wasted) AS wasted, sum(((CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END) >> k) + 1 + k) + ord * (17 - any_value(wasted)) AS cost
          FROM e, (SELECT unnest(range(0, 15)) AS k) WHERE i >= ord GROUP BY user_id, blk, ord, k),
    b AS (SELECT *, CASE WHEN kinds = 1 THEN 'constant' WHEN cost >= len * (17 - wasted) THEN 'verbatim' ELSE 'fixed' END AS kind FROM c QUALIFY row_number() OVER (PARTITION BY user_id, blk ORDER BY cost, ord, k) = 1),
    u AS (SELECT kind, CASE WHEN kind = 'fixed' THEN ord ELSE 0 END AS ord, wasted, (kind = 'fixed')::INT AS parts, CASE WHEN kind = 'fixed' THEN k ELSE 0 END AS k FROM b UNION ALL SELECT 'constant', 0, 0, 0, 0 FROM w)
    SELECT kind, ord::INT AS "order", count(*) AS n, max(wasted)::INT AS wasted, max(parts)::INT AS partitions, max(k)::INT AS max_parameter, 0::INT AS escaped FROM u GROUP BY kind, ord
"""


@query("flac_census", _CENSUS_SQL)
def flac_census(spark, sf):
    """Kinds and orders the writer chose and the worst shapes of their residuals."""
    return flac.subframe_census(flac.read_frames(_files(spark, sf, _flac)))


@query("packed_frames", f"SELECT user_id, f::INT AS frame FROM (SELECT user_id, unnest(range(0, (count(*) + 31) // 32)) AS f FROM ({_HALF_SQL}) GROUP BY user_id)")
def packed_frames(spark, sf):
    files = _files(spark, sf, lambda x: containers.pack_flac(_flac(x)))
    return containers.read(files, "gafp").where("bytes > 0").select(_user(), "frame")


@query("wav_samples", f"SELECT user_id, n AS i, x::FLOAT AS \"left\", x::FLOAT AS \"right\" FROM ({_HALF_SQL})")
def wav_samples(spark, sf):
    files = _files(spark, sf, lambda x: wav.build(np.array(x)[:, None], 8000))
    return wav.samples(wav.read(files, rows=50)).select(_user(), "i", "left", "right")


@query("pair_samples", f"SELECT user_id, n AS i, x::FLOAT AS \"left\", (-x)::FLOAT AS \"right\" FROM ({_HALF_SQL})")
def pair_samples(spark, sf):
    files = _files(spark, sf, lambda x: np.array([[v, -v] for v in x], "<f4").tobytes())
    blocks = wav.read_pairs(files, rows=50).withColumn("error", F.lit(None))
    return wav.samples(blocks).select(_user(), "i", "left", "right")


def _turns(spark, sf, build, schema="binary"):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    @F.pandas_udf(schema)
    def run(roles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([build(list(r), list(x)) for r, x in zip(roles, texts, strict=True)])

    return rows.select(F.col("conv_id").cast("string").alias("path"), run(F.col("t.role"), F.col("t.text")).alias("content"))


def _ogg(roles: list[str], texts: list[str]) -> bytes:
    out, body, lacing, flags = [], b"", b"", 2
    for text in texts:
        raw = text.encode()
        sizes = [255] * (len(raw) // 255) + [len(raw) % 255]
        for size in sizes:
            body, raw, lacing = body + raw[:size], raw[size:], lacing + bytes([size])
            if len(lacing) == 8:
                out.append(ogg.build_page(len(out), body, lacing, flags))
                body, lacing, flags = b"", b"", int(size == 255)
    if lacing:
        out.append(ogg.build_page(len(out), body, lacing, flags))
    return b"".join(out)


@query("ogg_packets", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS packet, coalesce(text, '') AS text FROM conversations")
def ogg_packets(spark, sf):
    """Texts as packets across pages of eight segments."""
    p = ogg.read_packets(_turns(spark, sf, _ogg))
    return p.select(F.col("path").cast("long").alias("conv_id"), "packet", F.decode("data", "UTF-8").alias("text"))


@query(
    "album_tracks",
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS track, 1000 + strlen(coalesce(text, '')) AS samples, role FROM conversations)
       SELECT conv_id, track::INT AS track, coalesce(sum(samples) OVER (PARTITION BY conv_id ORDER BY track ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_sample, samples, role AS title FROM t""",
)
def album_tracks(spark, sf):
    def build(roles, texts):
        return containers.build_albm("Album", "Artist", 2000, [{"samples": 1000 + len(x.encode()), "title": r, "artist": "Artist", "asset": x.encode() or b"-"} for r, x in zip(roles, texts, strict=True)])

    return containers.read(_turns(spark, sf, build), "albm").select(F.col("path").cast("long").alias("conv_id"), "track", "start_sample", "samples", "title")


@query("symbol_stream", "SELECT vec_id, 0 AS frame, 90 AS g, list_sum(list_transform(embedding, lambda x: abs(round(x * 40))))::BIGINT AS magnitude FROM embeddings")
def symbol_stream(spark, sf):
    """Quantised vectors as the four lowest bands of one frame each, written as an album and read back."""

    @F.pandas_udf("binary")
    def build(values: pd.Series) -> pd.Series:
        tables = uli.Tables.default()
        blob, out = tables.blob(), []
        track = [{"start_sample": 0, "samples": 512, "preroll_frame": 0, "skip": 0, "title": "t", "artist": "a"}]
        for v in values:
            scaled = np.asarray(v, np.float32) * np.float32(40)  # in the column's own precision; half away from zero
            m = (np.floor(np.abs(scaled.astype(float)) + 0.5) * np.sign(scaled)).astype(int).tolist()
            frame = {"g": 90, "ms": 0, "channels": [[(6, m[16 * b : 16 * b + 16]) for b in range(4)], []]}
            stream, places = uli.write_frames([frame], tables)
            out.append(containers.build_ula2(track, places, blob, stream, 512))
        return pd.Series(out)

    files = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), build("embedding").alias("content"))
    bands = F.transform(F.get("channels", F.lit(0)), lambda band: F.aggregate(band["m"], F.lit(0).cast("long"), lambda s, x: s + F.abs(x)))
    return uli.read_symbols(files).select(F.col("path").cast("long").alias("vec_id"), "frame", "g", F.aggregate(bands, F.lit(0).cast("long"), lambda s, x: s + x).alias("magnitude"))


@query(
    "palette_images",
    f"""WITH s AS (SELECT user_id, n, (x % 11) * 97 AS c FROM ({SIGNAL_SQL})), t AS (SELECT user_id, (max(n) // 64 + 1) * 64 AS m FROM s GROUP BY user_id), p AS (SELECT user_id, unnest(range(0, m)) AS n FROM t)
        SELECT p.user_id, p.n // 64 AS tile, p.n % 64 // 8 AS y, p.n % 8 AS x, coalesce(s.c, 0) AS colour FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.n = p.n""",
)
def palette_images(spark, sf):
    """All of each user's samples as images of exact palette colours, one 8 x 8 image for each 64; the last is padded with colour 0."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = signal(spark, sf).select("user_id", (F.row_number().over(w) - 1).alias("n"), ((F.col("x") % 11) * 97).alias("c"))
    rows = s.groupBy("user_id", F.expr("n div 64").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("s")).select("user_id", "tile", F.col("s.c").alias("c"))

    @F.pandas_udf("binary")
    def build(values: pd.Series) -> pd.Series:
        padded = ([int(c) for c in v] + [0] * (64 - len(v)) for v in values)
        return pd.Series([containers.build_art1([v[8 * y : 8 * y + 8] for y in range(8)]) for v in padded])

    files = rows.select(F.concat_ws("/", "user_id", "tile").alias("path"), build("c").alias("content"))
    at = F.split("path", "/")
    return containers.read(files, "art1").select(at[0].cast("long").alias("user_id"), at[1].cast("long").alias("tile"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("colour").cast("long").alias("colour"))


# scans

_FRAMES_SQL = f"SELECT user_id, count(*) AS n, (count(*) + 31) // 32 AS frames FROM ({_HALF_SQL}) GROUP BY user_id"


@query("scanner_precision", f"SELECT user_id, frames::INT AS expected, frames::INT AS strict, true AS exact, true AS in_order FROM ({_FRAMES_SQL})")
def scanner_precision(spark, sf):
    """Strict headers are the frames and nothing else; sync shapes find them all, and more."""
    p = scan.precision(_files(spark, sf, _flac))
    return p.select(_user(), "expected", "strict", "exact", ((F.col("sync") >= F.col("lenient")) & (F.col("sync") >= F.col("strict"))).alias("in_order"))


@query("frame_starts", f"SELECT user_id, f AS number, true AS any_form FROM (SELECT user_id, unnest(range(0, frames)) AS f FROM ({_FRAMES_SQL}))")
def frame_starts(spark, sf):
    """All strict frame starts of each stream, which a reader of any number form accepts as well."""
    return scan.candidates(_files(spark, sf, _flac)).where("strict").select(_user(), "number", "any_form")


@query("number_forms", f"SELECT user_id, unnest([2, 3, 4])::INT AS octets, true AS shortest_refused, true AS any_form, true AS frame_crc, (frames - 1)::INT AS frames FROM ({_FRAMES_SQL})")
def number_forms(spark, sf):
    """A frame whose number is written longer is sound but for its form; a resync leaves out that frame alone."""
    return scan.number_forms(_files(spark, sf, _flac)).select(_user(), "octets", "shortest_refused", "any_form", "frame_crc", "frames")


@query("bit_headers", f"SELECT user_id, s::INT AS shift, true AS at_bit, s = 0 AS at_byte FROM (SELECT user_id, unnest(range(0, 8)) AS s FROM ({_FRAMES_SQL}))")
def bit_headers(spark, sf):
    return scan.bit_offsets(_files(spark, sf, _flac)).select(_user(), "shift", "at_bit", "at_byte")


@query("checksum_reach", f"SELECT user_id, f::INT AS frame, true AS whole, false AS body_alone FROM (SELECT user_id, unnest(range(0, frames)) AS f FROM ({_FRAMES_SQL}))")
def checksum_reach(spark, sf):
    return scan.checksums(_files(spark, sf, _flac)).select(_user(), "frame", "whole", "body_alone")


@query("number_octets_census", f"SELECT octets, count(*) AS n FROM (SELECT CASE WHEN f < 128 THEN 1 ELSE 2 END AS octets FROM (SELECT unnest(range(0, frames)) AS f FROM ({_FRAMES_SQL}))) GROUP BY octets")
def number_octets_census(spark, sf):
    """Octets of the frames' numbers, from the size of their headers: 4 fixed bytes, the block's tail, the CRC-8."""
    h = flac.read_frames(_files(spark, sf, _flac)).select((F.col("header_bytes") - 6).alias("octets"))
    return h.groupBy("octets").agg(F.count(F.lit(1)).alias("n"))


# audits and pins


@query(
    "gafp_audit",
    f"""SELECT user_id, CASE user_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['magic'] WHEN 2 THEN ['recorded order', 'rate'] ELSE ['frame region', 'slice ' || (frames - 1) || ': checksum'] END::VARCHAR[] AS problems FROM ({_FRAMES_SQL})""",
)
def gafp_audit(spark, sf):
    """Containers with planted faults: each user's by the remainder of the id."""

    def build(x):
        source = _flac(x)
        return len(source).to_bytes(4, "big") + source + containers.pack_flac(source)

    @F.pandas_udf("struct<content:binary,source:binary>")
    def damaged(users: pd.Series, values: pd.Series) -> pd.DataFrame:
        rows = []
        for user, v in zip(users, values, strict=True):
            n = int.from_bytes(v[:4], "big")
            source, blob = v[4 : 4 + n], bytearray(v[4 + n :])
            if user % 4 == 1:
                blob[0] ^= 1
            elif user % 4 == 2:
                blob[7] ^= 8
                blob[10] ^= 1
            elif user % 4 == 3:
                blob[-1] ^= 1
            rows.append((bytes(blob), source))
        return pd.DataFrame(rows, columns=["content", "source"])

    files = _files(spark, sf, build).select("path", damaged(F.col("path").cast("long"), "content").alias("c")).select("path", "c.content", "c.source")
    return audit.problems(files, "gafp").select(_user(), "problems")


@query(
    "albm_audit",
    """WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
       SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['reserved byte 7', 'reserved bytes 54 to 59'] WHEN 2 THEN ['track 0: reciprocal', 'structure seal'] ELSE ['asset seal'] END::VARCHAR[] AS problems FROM t""",
)
def albm_audit(spark, sf):
    """Albums with planted faults: reserved bytes, a reciprocal, the last byte of the assets."""

    def build(roles, texts):
        return containers.build_albm("Album", "Artist", 2000, [{"samples": 1000 + len(x.encode()), "title": r, "artist": "Artist", "asset": (x.encode() or b"-").ljust(-(-max(1, len(x.encode())) // 4) * 4, b" ")} for r, x in zip(roles, texts, strict=True)])

    @F.pandas_udf("binary")
    def damaged(convs: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for conv, v in zip(convs, values, strict=True):
            blob = bytearray(v)
            for at in {1: (7, 56), 2: (72,), 3: (len(blob) - 1,)}.get(conv % 4, ()):
                blob[at] ^= 1
            out.append(bytes(blob))
        return pd.Series(out)

    files = _turns(spark, sf, build).select("path", damaged(F.col("path").cast("long"), "content").alias("content"))
    return audit.problems(files, "albm").select(F.col("path").cast("long").alias("conv_id"), "problems")


@query(
    "stream_audit",
    f"""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN [] WHEN user_id % 3 = 1 THEN [n || ' samples, ' || (n + 1) || ' declared'] ELSE ['seek point 0: no frame of its sample and size'] END::VARCHAR[] AS problems FROM ({_FRAMES_SQL})""",
)
def stream_audit(spark, sf):
    """Streams whose declaration or first seek point was changed."""

    @F.pandas_udf("binary")
    def damaged(users: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for user, v in zip(users, values, strict=True):
            data = bytearray(v)
            if user % 3 == 1:
                n = int.from_bytes(data[21:26], "big") + 1  # the low bits of the samples, 4 bytes into STREAMINFO's 13th
                data[21:26] = n.to_bytes(5, "big")
            elif user % 3 == 2:
                data[42 + 4 + 8 + 7] ^= 1  # the first point's offset
            out.append(bytes(data))
        return pd.Series(out)

    files = _files(spark, sf, _flac).select("path", damaged(F.col("path").cast("long"), "content").alias("content"))
    return audit.problems(files, "stream").select(_user(), "problems")


_FNV64_STEP = "((xor(r, b::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


def _fnv64_sql(items: str) -> str:
    return f"lower(lpad(hex(list_reduce({items}, lambda r, b: {_FNV64_STEP}, {FNV64[0]}::HUGEINT)::UBIGINT), 16, '0'))"


_PAIR_BYTES = "flatten(list_transform(xs, lambda x: [x & 255, (x >> 8) & 255, (-x) & 255, ((-x) >> 8) & 255]))"


@query(
    "pcm_pins",
    f"""WITH s AS (SELECT user_id, n // 32 AS frame, list(x ORDER BY n) AS xs FROM ({_HALF_SQL}) GROUP BY ALL UNION ALL SELECT user_id, NULL, list(x ORDER BY n) FROM ({_HALF_SQL}) GROUP BY user_id),
        b AS (SELECT user_id, frame, xs, {_PAIR_BYTES} AS bytes, list_transform(xs, lambda x: (x >> 8) & 255) AS l, list_transform(xs, lambda x: ((-x) >> 8) & 255) AS r FROM s)
        SELECT user_id, frame::INT AS frame, len(xs)::BIGINT AS samples, xs[1]::INT AS first_left, xs[-1]::INT AS last_left, {_fnv64_sql("bytes")} AS pcm, {_fnv64_sql("l")} AS played_left, {_fnv64_sql("r")} AS played_right,
               CASE WHEN frame IS NOT NULL THEN list_reduce(list_concat(l, r), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT) END AS frame_hash FROM b""",
)
def pcm_pins(spark, sf):
    """Digests of what each frame and file decodes to, as samples and as played bytes; a sample beyond 16 bits counts by its low 16."""
    p = audit.pins(_files(spark, sf, _flac_whole), low=True)
    return p.select(_user(), "frame", "samples", F.get("first", F.lit(0)).alias("first_left"), F.get("last", F.lit(0)).alias("last_left"), "pcm", "played_left", "played_right", "frame_hash")


@query("packed_samples", f"SELECT user_id, n AS i, x::INT AS \"left\", (-x)::INT AS \"right\" FROM ({_HALF_SQL})")
def packed_samples(spark, sf):
    """What a packed container decodes to, entered at every frame by its offset table."""
    files = _files(spark, sf, lambda x: containers.pack_flac(_flac(x)))
    return containers.packed_pcm(files).select(_user(), "i", "left", "right")


@query("slot_census", f"SELECT user_id, slot, sum(n)::BIGINT AS n FROM (SELECT user_id, unnest([0, 1])::INT AS slot, frames AS n FROM ({_FRAMES_SQL})) GROUP BY ALL")
def slot_census(spark, sf):
    """Subframes by slot, summed over kinds and orders."""
    _, _, subframes = audit.facts_tables(flac.read_frames(_files(spark, sf, _flac)))
    return audit.slot_census(subframes).groupBy(_user(), "slot").agg(F.sum("n").alias("n"))


@query("profile_verdicts", f"SELECT user_id, CASE WHEN n < 32 THEN ['block'] ELSE [] END::VARCHAR[] AS reasons FROM ({_FRAMES_SQL})")
def profile_verdicts(spark, sf):
    """Facts of every stream against a profile of blocks of 32."""
    blobs, _, _ = audit.facts_tables(flac.read_frames(_files(spark, sf, _flac)))
    return audit.profile_verdict(blobs, audit.PROFILE | {"blocks": (32,), "max_order": 4}).select(_user(), "reasons")


@query(
    "sample_agreements",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1)
       SELECT coalesce(a.k, b.k, c.k)::VARCHAR AS path, [a.n, b.n, c.n] AS counts FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON c.k = coalesce(a.k, b.k) WHERE a.n IS NULL OR b.n IS NULL OR c.n IS NULL OR a.n <> b.n OR b.n <> c.n""",
)
def sample_agreements(spark, sf):
    """Three counts of the same thing, where they differ or one is missing."""
    o = table(spark, sf, "orders").withColumn("path", F.col("o_custkey").cast("string"))
    return audit.sample_agreement(*[o.where(c).groupBy("path").agg(F.count(F.lit(1)).alias("samples")) for c in ("o_orderstatus <> 'P'", "true", "o_totalprice > 1000")])


@query("file_tags", "SELECT conv_id, 'turns ' || count(*) AS title, '?' AS artist FROM conversations GROUP BY conv_id")
def file_tags(spark, sf):
    """Titles from a stream's comments; the artist's is empty."""
    files = _turns(spark, sf, lambda roles, texts: flac.with_comments(flac.encode([[len(texts), 0, 1]]), {"TITLE": f" turns {len(texts)} ", "artist": " "}))
    return flac.read_tags(files).select(F.col("path").cast("long").alias("conv_id"), "title", "artist")


@query("resync_frames", f"SELECT user_id, (frames - 1)::BIGINT AS good, 1::BIGINT AS damaged, (frames > 1)::INT::BIGINT AS last_found FROM ({_FRAMES_SQL})")
def resync_frames(spark, sf):
    """A damaged first frame is one row with its error, and the walk goes on at the next strict header."""

    @F.pandas_udf("binary")
    def damaged(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            data = bytearray(v)
            first = next(flac.walk(bytes(v)))
            data[first["offset"] + first["bytes"] - 1] ^= 1
            out.append(bytes(data))
        return pd.Series(out)

    files = _files(spark, sf, _flac).select("path", damaged("content").alias("content"))
    f = flac.read_frames(files, resync=True)
    return f.groupBy(_user()).agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("damaged"), F.max(F.when(F.col("error").isNull(), 1).otherwise(0)).cast("long").alias("last_found"))


@query("opus_heads", "SELECT conv_id, 1 AS version, (1 + conv_id % 2)::INT AS channels, (conv_id % 5000)::INT AS pre_skip, 48000::BIGINT AS rate, (-(conv_id % 256))::INT AS gain FROM conversations GROUP BY conv_id")
def opus_heads(spark, sf):
    """First packets of Ogg streams, read as identification headers."""
    c = table(spark, sf, "conversations").select("conv_id").distinct()

    @F.pandas_udf("binary")
    def build(convs: pd.Series) -> pd.Series:
        heads = (b"OpusHead" + struct.pack("<BBHIhB", 1, 1 + c % 2, c % 5000, 48000, -(c % 256), 0) for c in convs.tolist())
        return pd.Series([ogg.build_page(0, h, bytes([len(h)]), 2) for h in heads])

    files = c.select(F.col("conv_id").cast("string").alias("path"), build("conv_id").alias("content"))

    @F.pandas_udf("struct<version:int,channels:int,pre_skip:int,rate:long,gain:int>")
    def read(packets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{k: v for k, v in ogg.opus_head(bytes(p)).items() if k != "family"} for p in packets])

    return ogg.read_packets(files).where("packet = 0").select(F.col("path").cast("long").alias("conv_id"), read("data").alias("h")).select("conv_id", "h.*")


@query("ula_tracks", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS track, 512 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS start_sample, 512::BIGINT AS samples, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS preroll_frame, role AS title FROM conversations")
def ula_tracks(spark, sf):
    """The track rows of lossy albums, with their strings."""

    def build(roles, texts):
        t = uli.Tables.default()
        frames = [{"g": 60 + i, "ms": i % 2, "channels": [[], []]} for i in range(len(roles) + 1)]
        stream, places = uli.write_frames(frames, t)
        rows = [{"start_sample": 512 * i, "samples": 512, "preroll_frame": i, "skip": 0, "title": r, "artist": "A"} for i, r in enumerate(roles)]
        return containers.build_ula2(rows, places, t.blob(), stream, 512 * len(roles))

    return containers.read(_turns(spark, sf, build), "ula2").select(F.col("path").cast("long").alias("conv_id"), "track", "start_sample", "samples", "preroll_frame", "title")


@query("frame_data_offsets", f"SELECT user_id, 4 + 38 + 4 + 18 * ((frames + 1) // 2) AS frame_data FROM ({_FRAMES_SQL})")
def frame_data_offsets(spark, sf):
    """Where each stream's frames begin, from its blocks alone."""
    b = flac.read_blocks(_files(spark, sf, _flac))
    return b.groupBy(_user()).agg(F.max(F.col("offset") + F.col("length")).alias("frame_data"))


@query("range_gate", f"SELECT user_id, bool_and(x * 3 - 70000 BETWEEN -32768 AND 32767) AS fits, min(CASE WHEN x * 3 - 70000 NOT BETWEEN -32768 AND 32767 THEN n END) AS first_bad FROM ({SIGNAL_SQL}) GROUP BY user_id")
def range_gate(spark, sf):
    """If a whole signal fits 16 bits, and its first sample that doesn't."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = signal(spark, sf).select("user_id", (F.row_number().over(w) - 1).cast("long").alias("n"), (F.col("x") * 3 - 70000).alias("x"))
    return s.groupBy("user_id").agg(F.bool_and(fits16("x")).alias("fits"), F.min(F.when(~fits16("x"), F.col("n"))).alias("first_bad"))


@query("tables_premise", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN 'raw' ELSE 'offset' END AS what, CASE WHEN conv_id % 3 = 1 THEN 2 WHEN conv_id % 3 = 2 THEN 5 END::INT AS class FROM conversations GROUP BY conv_id")
def tables_premise(spark, sf):
    """The first violation of code tables, some of them spoilt: raw bits of a quad class, a level that would turn negative."""

    @F.pandas_udf("struct<what:string,class:int>")
    def run(convs: pd.Series) -> pd.DataFrame:
        rows = []
        for c in convs.tolist():
            t = uli.Tables.parse(uli.Tables.default().blob())
            if c % 3 == 1:
                t.raw[2] = 1
            elif c % 3 == 2:
                t.offsets[5][1] = 16
            found = min(t.violations(), default=(None, None, None))
            rows.append((found[1], found[0]))
        return pd.DataFrame(rows, columns=["what", "class"]).astype({"class": "Int32"})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # ids are few bytes: without a number, all would come to one task
    each = table(spark, sf, "conversations").select("conv_id").repartition(tasks, "conv_id").distinct()
    return each.select("conv_id", run("conv_id").alias("r")).select("conv_id", "r.*")
