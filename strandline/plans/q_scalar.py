"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import bits as B
from strandline.functions import clocks as K
from strandline.functions import codes as C
from strandline.functions import digest as D
from strandline.plans.registry import query
from strandline.session import table

WORD = "((event_id * 2654435761) & 4294967295)"


@query(
    "bit_fields",
    f"""SELECT event_id, ({WORD} >> 24) & 31 AS f5, ({WORD} >> 7) & 8191 AS f13, {WORD} >> 28 AS top4,
        CASE WHEN (({WORD} >> 7) & 8191) >= 4096 THEN (({WORD} >> 7) & 8191) - 8192 ELSE ({WORD} >> 7) & 8191 END AS s13,
        (8 - event_id % 8) % 8 AS padding,
        list_sum(list_transform(range(32), lambda k: ((({WORD} >> k) & 1) << (31 - k))))::BIGINT AS reversed FROM events""",
)
def bit_fields(spark, sf):
    w = F.expr(WORD)
    return table(spark, sf, "events").select(
        "event_id", B.field(w, 3, 5).alias("f5"), B.field(w, 12, 13).alias("f13"), B.field(w, 0, 4).alias("top4"), B.sign_extend(B.field(w, 12, 13), 13).alias("s13"),
        B.padding("event_id").cast("long").alias("padding"), B.reverse32(w).alias("reversed"),
    )


NUMBER = "(event_id * event_id * 37 + event_id) % 68719476736"


@query(
    "coded_numbers",
    f"""WITH v AS (SELECT event_id, {NUMBER} AS v FROM events),
        n AS (SELECT *, CASE WHEN v < 128 THEN 1 WHEN v < 2048 THEN 2 WHEN v < 65536 THEN 3 WHEN v < 2097152 THEN 4 WHEN v < 67108864 THEN 5 WHEN v < 2147483648 THEN 6 ELSE 7 END AS octets FROM v)
        SELECT event_id, v AS value, octets, CASE WHEN octets = 1 THEN v ELSE (v >> (6 * (octets - 1))) + ((255 << (8 - octets)) & 255) END AS lead_byte, octets AS lead_octets, v AS decoded FROM n""",
)
def coded_numbers(spark, sf):
    v = table(spark, sf, "events").select("event_id", F.expr(NUMBER).alias("value")).withColumn("code", B.encode_number("value"))
    lead = F.conv(F.substring("code", 1, 2), 16, 10).cast("long")
    return v.select("event_id", "value", B.number_octets("value").alias("octets"), lead.alias("lead_byte"), B.lead_octets(lead).alias("lead_octets"), B.decode_number("code").alias("decoded"))


DELTA = "(cast(round(value * 100) as bigint) - 10000)"


@query(
    "zigzag_golomb",
    f"""WITH z AS (SELECT event_id, {DELTA} AS d, CASE WHEN {DELTA} >= 0 THEN 2 * {DELTA} ELSE -2 * {DELTA} - 1 END AS z FROM events)
        SELECT event_id, d, z, d AS back, 2 * length(bin((z >> 3) + 1)) - 1 + 3 AS bits,
               repeat('0', length(bin((z >> 3) + 1)) - 1) || bin((z >> 3) + 1) || right('000' || bin(z & 7), 3) AS code, z AS read FROM z""",
)
def zigzag_golomb(spark, sf):
    z = table(spark, sf, "events").select("event_id", F.expr(DELTA).alias("d")).withColumn("z", B.zigzag("d"))
    coded = z.withColumn("code", B.golomb_code("z", 3))
    return coded.select("event_id", "d", "z", B.unzigzag("z").alias("back"), B.golomb_bits("z", 3).cast("long").alias("bits"), "code", B.golomb_value("code", 3).alias("read"))


SAMPLE = "(cast(round(value * 100) as bigint) * 3 - 70000)"


@query(
    "pcm_scalars",
    f"""WITH s AS (SELECT event_id, {SAMPLE} AS s, value / 250 - 1 AS f FROM events)
        SELECT event_id, s, ((s + 2147483648) & 4294967295) - 2147483648 AS wrapped, (s * 65536 + 2147483648 & 4294967295) - 2147483648 AS wrapped_up, (s >> 8) & 255 AS fifo, s BETWEEN -32768 AND 32767 AS fits,
               (s * (event_id % 257)) >> 8 AS scaled, greatest(-32768, least(32767, floor(f * 32768 + 0.5)))::BIGINT AS folded, (s + event_id) >> 1 AS mixed, ((s & 65535) + 15 >> 4) + 4 + (((s & 65535) + 15 >> 4) + 4) % 2 AS halfwords FROM s""",
)
def pcm_scalars(spark, sf):
    s = table(spark, sf, "events").select("event_id", F.expr(SAMPLE).alias("s"), (F.col("value") / 250 - 1).alias("f"))
    return s.select(
        "event_id", "s", B.wrap32("s").alias("wrapped"), B.wrap32(F.col("s") * 65536).alias("wrapped_up"), B.fifo_byte("s").alias("fifo"), B.fits16("s").alias("fits"), B.scale_byte("s", F.col("event_id") % 257).alias("scaled"),
        B.fold_float("f").alias("folded"), B.fold_down("s", "event_id").alias("mixed"), B.halfwords(F.col("s").bitwiseAND(F.lit(65535).cast("long"))).alias("halfwords"),
    )


@query(
    "clock_scalars",
    """WITH p AS (SELECT event_id, event_id * 977 AS pos, 100000 + event_id % 7919 AS n, (event_id * 48271) % 4294967296 AS a, (event_id * 69621) % 4294967296 AS b FROM events)
       SELECT event_id, pos >> 14 AS seconds, (pos >> 14) // 60 AS minutes, (pos >> 14) % 60 AS rest, 137438953472 // n AS reciprocal, ((pos % n) * (137438953472 // n)) >> 32 AS cell,
              CASE WHEN b >= a THEN b - a ELSE 4294967295 END AS cycles, (pos % 4096) * 16777216 // 32768 AS budget,
              CASE WHEN pos % 2048 = 0 THEN pos // 2048 END AS frame, (nullif(pos, 0) + 2047) // 2048 AS frames, CASE WHEN pos >= n THEN n ELSE greatest(0, pos - 1136) END AS painted,
              (event_id + 7 - 1) % 7 AS previous_track FROM p""",
)
def clock_scalars(spark, sf):
    p = table(spark, sf, "events").select("event_id", F.expr("event_id * 977").alias("pos"), F.expr("100000 + event_id % 7919").alias("n"), F.expr("(event_id * 48271) % 4294967296").alias("a"), F.expr("(event_id * 69621) % 4294967296").alias("b"))
    q = p.withColumn("seconds", K.seconds("pos")).withColumn("reciprocal", B.bar_reciprocal("n"))
    return q.select(
        "event_id", "seconds", B.minutes("seconds").alias("minutes"), (F.col("seconds") - 60 * B.minutes("seconds")).alias("rest"), "reciprocal", K.elapsed_cell(F.col("pos") % F.col("n"), "reciprocal").alias("cell"), B.between_cycles("a", "b").alias("cycles"),
        K.frame_budget(F.col("pos") % 4096, 32768).alias("budget"), K.frame_at("pos").alias("frame"), K.frame_count("pos").alias("frames"), K.shown_position("pos", 1136, "n").alias("painted"), K.neighbour("event_id", 7, -1).alias("previous_track"),
    )


@query(
    "chain_scalars",
    """WITH p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 16384 WHEN 1 THEN 32768 ELSE 8192 END AS rate, 304 + 16 * (event_id % 32) AS chunk, event_id % 2000 AS lead, event_id % 700 AS prefill, (event_id * 48271) % 573441 AS cycles, event_id % 9 AS n FROM events)
       SELECT event_id, 16777216 // rate AS ticks_per_sample, chunk * (16777216 // rate) AS period_cycles, (lead * rate + chunk * 1000 - 1) // (chunk * 1000) AS ring_chunks, (lead * rate + chunk * 1000 - 1) // (chunk * 1000) * chunk AS ring_samples,
              (prefill * rate + chunk * 1000 - 1) // (chunk * 1000) AS prefill_chunks, (prefill * rate + chunk * 1000 - 1) // (chunk * 1000) * chunk AS prefill_samples, greatest(1, (cycles + 280895) // 280896)::INT AS video_frames,
              event_id % 560 + (n + 4) * 560 AS gap, greatest(2, n + 1) AS handoff, 5 * n + event_id % 4 AS resume, 65600 + n * 36904 AS boot, CASE WHEN event_id * 68719477 < 68719476736 THEN event_id * 68719477 END AS first_sample, gcd(event_id * 30, chunk * 7) AS divisor FROM p""",
)
def chain_scalars(spark, sf):
    """Geometry, latency bounds and byte bounds of the playback chain."""
    e = F.col("event_id")
    p = table(spark, sf, "events").select(
        "event_id", F.when(e % 3 == 0, 16384).when(e % 3 == 1, 32768).otherwise(8192).cast("long").alias("rate"), (304 + 16 * (e % 32)).alias("chunk"), (e % 2000).alias("lead"), (e % 700).alias("prefill"), ((e * 48271) % 573441).alias("cycles"), (e % 9).alias("n")
    )
    return p.select(
        "event_id", *[c.alias(name) for name, c in K.geometry("rate", "chunk", "lead", "prefill").items()], K.video_frames("cycles").alias("video_frames"), K.gap_samples(e % 560, "n").alias("gap"), K.handoff_bound("n").alias("handoff"),
        K.resume_bound("n", e % 4).alias("resume"), K.boot_bytes("n").alias("boot"), K.first_sample("event_id", 68719477).alias("first_sample"), K.gcd(e * 30, F.col("chunk") * 7).alias("divisor"),
    )


#: The codes' tables as SQL, value by code from 0 on; None stands for the stream's own, a tail in the header or a reserved code.
_RATES = ", ".join(str(C.RATE_CODES.get(c, "NULL")) for c in range(16))


@query(
    "header_codes",
    f"""WITH c AS (SELECT event_id, event_id % 16 AS code, 16384 + event_id % 5 AS stream_rate FROM events)
        SELECT event_id, code, coalesce([{_RATES}][code + 1], CASE WHEN code = 0 THEN stream_rate END)::BIGINT AS rate,
               CASE WHEN code = 1 THEN 192 WHEN code BETWEEN 2 AND 5 THEN 144 << code WHEN code >= 8 THEN 1 << code END::BIGINT AS block,
               CASE WHEN code < 8 THEN 'independent' WHEN code = 8 THEN 'left_side' WHEN code = 9 THEN 'side_right' WHEN code = 10 THEN 'mid_side' END AS layout,
               CASE code % 8 WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 4 THEN 16 WHEN 5 THEN 20 WHEN 6 THEN 24 WHEN 7 THEN 32 END::BIGINT AS sample_bits FROM c""",
)
def header_codes(spark, sf):
    """Every code of a frame header through the tables that the reader uses."""
    code = F.col("code")
    c = table(spark, sf, "events").select("event_id", (F.col("event_id") % 16).alias("code"), (16384 + F.col("event_id") % 5).alias("stream_rate"))
    return c.select("event_id", "code", C.rate(code, F.col("stream_rate")).alias("rate"), C.block_size(code).alias("block"), C.layout(code).alias("layout"), C.sample_bits(code % 8, F.lit(16).cast("long")).alias("sample_bits"))


@query(
    "packet_codes",
    """WITH t AS (SELECT event_id, event_id % 256 AS toc FROM events)
       SELECT event_id, toc >> 3 AS config, CASE WHEN toc >= 128 THEN 'CELT-only' WHEN (toc & 96) = 96 THEN 'Hybrid' ELSE 'SILK-only' END AS mode,
              CASE WHEN toc >= 128 THEN ['NB', 'WB', 'SWB', 'FB'][((toc >> 5) & 3) + 1] WHEN (toc & 96) = 96 THEN ['SWB', 'FB'][((toc >> 4) & 1) + 1] ELSE ['NB', 'MB', 'WB'][(toc >> 5) + 1] END AS bandwidth,
              CASE WHEN toc >= 128 THEN [2.5, 5, 10, 20][((toc >> 3) & 3) + 1] WHEN (toc & 96) = 96 THEN [10, 20][((toc >> 3) & 1) + 1] ELSE [10, 20, 40, 60][((toc >> 3) & 3) + 1] END::DOUBLE AS ms, toc & 3 AS frames_code FROM t""",
)
def packet_codes(spark, sf):
    from strandline.sources.ogg import packet_code

    return table(spark, sf, "events").select("event_id", *packet_code(F.col("event_id") % 256))


@query(
    "packet_census",
    """SELECT user_id, count(DISTINCT (event_id % 256) >> 3) AS configs, count(*) AS packets, count(DISTINCT (event_id % 256) >> 3) = 1 AS passes FROM events GROUP BY user_id""",
)
def packet_census(spark, sf):
    config = F.shiftright(F.col("event_id") % 256, 3)
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct(config).alias("configs"), F.count(F.lit(1)).alias("packets"), (F.count_distinct(config) == 1).alias("passes"))


def _bytes_sql(text: str) -> str:
    """The bytes of a text as a list."""
    return f"list_filter(list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '0x\\1,', 'g'), ','), lambda x: try_cast(x AS BIGINT)), lambda x: x IS NOT NULL)"


def _fold(step: str, start: str) -> str:
    return f"list_reduce(bytes, lambda r, b: {step}, {start})"


def _crc_step(width: int, poly: int) -> str:
    table_ = "[" + ", ".join(map(str, D.crc_table({8: "crc8", 16: "crc16", 32: "ogg"}[width]))) + "]"
    return f"xor((r << 8) & {(1 << width) - 1}, {table_}[(xor(r >> {width - 8}, b) & 255) + 1])"


def _digests_sql(key: str, text: str, source: str) -> str:
    fnv64 = _fold("((xor(r, b::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)", f"{D.FNV64[0]}::HUGEINT")
    return f"""WITH n AS MATERIALIZED (SELECT {key}, {_bytes_sql(text)} AS bytes FROM {source})
        SELECT {key}, {_fold(_crc_step(8, 7), "0::BIGINT")} AS crc8, {_fold(_crc_step(16, 0x8005), "0::BIGINT")} AS crc16, {_fold(_crc_step(32, 0x04C11DB7), "0::BIGINT")} AS ogg,
               {_fnv32_sql()} AS fnv32, lower(lpad(hex({fnv64}::UBIGINT), 16, '0')) AS fnv64 FROM n"""


def _fnv32_sql() -> str:
    return _fold("(xor(r, b) * 16777619) & 4294967295", "2166136261::BIGINT")


@query("short_digests", _digests_sql("p_partkey", "p_name", "part"))
def short_digests(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", *[D.crc_short(k, name).alias(k) for k in D.CRCS], D.fnv32_short(name).alias("fnv32"), D.fnv64_short(name).alias("fnv64"))


@query("document_digests", _digests_sql("doc_id", "coalesce(text, '')", "documents"))
def document_digests(spark, sf):
    """Whole texts through the Arrow forms."""
    return table(spark, sf, "documents").select("doc_id", D.digests(F.coalesce("text", F.lit(""))).alias("d")).select("doc_id", "d.*")


@query(
    "content_tripwire",
    f"""WITH n AS MATERIALIZED (SELECT page_id, {_bytes_sql("coalesce(html, '')")} AS whole FROM pages), h AS (SELECT page_id, whole[1:32768] AS bytes FROM n), t AS (SELECT page_id, whole[greatest(1, len(whole) - 4095):len(whole)] AS bytes FROM n)
        SELECT h.page_id, head, tail FROM (SELECT page_id, {_fnv32_sql()} AS head FROM h) h JOIN (SELECT page_id, {_fnv32_sql()} AS tail FROM t) t ON t.page_id = h.page_id""",
)
def content_tripwire(spark, sf):
    """FNV of the first 32 KiB and of the last 4 KiB of each page: the bounded check is the feature."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return table(spark, sf, "pages").select("page_id", D.fnv_udf(32)(F.substring(raw, 1, 32768)).alias("head"), D.fnv_udf(32)(F.expr("substring(encode(coalesce(html, ''), 'UTF-8'), -4096)")).alias("tail"))


@query("identity_sha", "SELECT page_id, sha256(coalesce(html, '')) AS identity FROM pages")
def identity_sha(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("identity"))


FOLDED = "trim(regexp_replace(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'), '[ \\t\\n\\x0b\\f\\r\\x1c-\\x1f]+', ' ', 'g'))"


@query(
    "title_fold",
    f"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '( ' || p_name || ' )' ELSE p_name || '  ' || p_type END AS t FROM part), f AS (SELECT p_partkey, {FOLDED} AS f FROM t),
        g AS (SELECT p_partkey, CASE WHEN length(f) >= 2 AND f LIKE '(%)' AND trim(f[2:-2]) <> '' THEN trim(f[2:-2]) ELSE f END AS folded FROM f)
        SELECT p_partkey, folded, length(folded) <= 28 AS fits, length(folded) <= 30 AND regexp_full_match(folded, '[ -~]*') AS renderable FROM g""",
)
def title_fold(spark, sf):
    from strandline.functions.titles import fits, fold, renderable

    t = F.expr("case when p_partkey % 3 = 0 then '( ' || p_name || ' )' else p_name || '  ' || p_type end")
    f = table(spark, sf, "part").select("p_partkey", fold(t).alias("folded"))
    return f.select("p_partkey", "folded", fits(F.col("folded")).alias("fits"), renderable(F.col("folded")).alias("renderable"))


@query(
    "budget_formats",
    """SELECT p_partkey, (p_size * 1237) // 1000 || '.' || lpad(((p_size * 1237) % 1000)::VARCHAR, 3, '0') AS text, greatest(0, least(16, 500 - 16 * (p_partkey % 40)))::BIGINT AS band_coefficients,
              greatest(1, least(65535, (268435456 // (p_size * 16)) // 16 - 1))::BIGINT AS largest, (p_size / 100.0 * 262144)::DOUBLE::BIGINT AS cap,
              greatest(8, least(187, round(32 + 8 * log2(sqrt(p_retailprice / (p_size * 0.13))))))::BIGINT AS guess FROM part""",
)
def budget_formats(spark, sf):
    p = table(spark, sf, "part").withColumn("size", F.col("p_size").cast("long"))
    return p.select(
        "p_partkey", B.fixed3(F.col("size") * 1237).alias("text"), B.band_coefficients(F.col("p_partkey") % 40).cast("long").alias("band_coefficients"), B.largest_magnitude(F.col("size") * 16).alias("largest"),
        F.round(F.col("size") / 100.0 * 262144).cast("long").alias("cap"), F.greatest(F.lit(8), F.least(F.lit(187), F.round(32 + 8 * F.log2(F.sqrt(F.col("p_retailprice") / (F.col("size") * 0.13)))))).cast("long").alias("guess"),
    )


#: The weights of the linear cost model, per frame and per counted operation.
COSTS = {"bandsyms": 30, "coded_bands": 40, "pairs": 44, "quads": 52, "nz": 22, "zc": 3, "raws": 8, "escs": 45, "long_codes": 40}
COST_BASE, COST_MS = 5200 + 2 * 300 + 2 * (73297 + 3 * 512), 3 * 512


@query(
    "cycle_model",
    f"""WITH o AS (SELECT l_orderkey, count(*) AS bandsyms, count(*) FILTER (l_returnflag = 'R') AS coded_bands, sum(l_quantity)::BIGINT AS pairs, count(*) FILTER (l_linestatus = 'O') AS quads, count(DISTINCT l_partkey) AS nz,
                       count(DISTINCT l_suppkey) AS zc, max(l_linenumber)::BIGINT AS raws, count(*) FILTER (l_discount > 0.05) AS escs, count(*) FILTER (l_tax > 0.04) AS long_codes, l_orderkey % 2 AS ms FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, {COST_BASE} + CASE WHEN ms <> 0 THEN {COST_MS} ELSE 0 END + 5 * ((1024 - 16 * coded_bands) // 4) + {" + ".join(f"{v} * {k}" for k, v in COSTS.items())} AS cycles FROM o""",
)
def cycle_model(spark, sf):
    o = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("bandsyms"), F.count_if(F.col("l_returnflag") == "R").alias("coded_bands"), F.sum("l_quantity").cast("long").alias("pairs"), F.count_if(F.col("l_linestatus") == "O").alias("quads"),
            F.count_distinct("l_partkey").alias("nz"), F.count_distinct("l_suppkey").alias("zc"), F.max("l_linenumber").cast("long").alias("raws"), F.count_if(F.col("l_discount") > 0.05).alias("escs"), F.count_if(F.col("l_tax") > 0.04).alias("long_codes"),
        )
    )
    return o.select("l_orderkey", cost_of(F.col("l_orderkey") % 2 != 0).alias("cycles"))


def cost_of(ms):
    """The cost model as one projection over the counted operations."""
    return COST_BASE + F.when(ms, COST_MS).otherwise(0) + 5 * F.expr("(1024 - 16 * coded_bands) div 4") + sum((F.col(k) * v for k, v in COSTS.items()), F.lit(0))
