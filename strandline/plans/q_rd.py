"""Quantisation, rate curves and transforms over embeddings: 64 dimensions as 4 bands of 16."""

from __future__ import annotations

from math import pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.functions import bits as B
from strandline.operators import rd as R
from strandline.operators import transform as T
from strandline.plans.q_predict import SIGNAL_SQL, signal
from strandline.plans.registry import query
from strandline.session import table

DIMS_SQL = "SELECT vec_id, unnest(range(0, 64))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"


def dims(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))


def _quant_sql(step: str) -> str:
    f = f"least(floor(abs(x) / {step}), 65535)::BIGINT"
    e = lambda m: f"pow(abs(x) - ({m} - 0.1875) * {step}, 2)"
    zero = "x * x"
    return f"CASE WHEN {f} = 0 THEN (CASE WHEN {e('1')} < {zero} THEN 1 ELSE 0 END) ELSE (CASE WHEN {zero} <= {e(f)} AND {zero} <= {e(f'({f} + 1)')} THEN 0 WHEN {e(f)} <= {e(f'({f} + 1)')} THEN {f} ELSE {f} + 1 END) END"


@query("quantise_fixed_step", f"SELECT vec_id, i, ({_quant_sql('0.0625')})::BIGINT AS m FROM ({DIMS_SQL})")
def quantise_fixed_step(spark, sf):
    return dims(spark, sf).select("vec_id", "i", R.quantise(F.col("x"), F.lit(0.0625)).alias("m"))


HEADROOM = [0, 1, 3, 7, 15, 31]


@query(
    "band_classes",
    f"""WITH q AS (SELECT vec_id, i // 16 AS band, ({_quant_sql('0.02')})::BIGINT AS m FROM ({DIMS_SQL})), b AS (SELECT vec_id, band, max(m) AS largest, sum(m) AS total, count(*) FILTER (m <> 0) AS nonzero,
            sum(CASE WHEN (m >> 1) >= 15 THEN 2 * length(bin(((m >> 1) - 15 >> 0) + 1)) - 1 ELSE 0 END + 1 + (m <> 0)::INT)::BIGINT AS extra FROM q GROUP BY ALL)
        SELECT vec_id, band::BIGINT AS band, largest, nonzero, extra, CASE WHEN largest <= 0 THEN 0 WHEN largest <= 1 THEN 1 WHEN largest <= 3 THEN 2 WHEN largest <= 7 THEN 3 WHEN largest <= 15 THEN 4 ELSE 5 END AS class FROM b""",
)
def band_classes(spark, sf):
    q = dims(spark, sf).select("vec_id", F.expr("i div 16").alias("band"), R.quantise(F.col("x"), F.lit(0.02)).alias("m"))
    b = q.groupBy("vec_id", "band").agg(F.max("m").alias("largest"), F.count_if(F.col("m") != 0).alias("nonzero"), F.sum(R.extra_bits(F.col("m"), 1, 0)).alias("extra"))
    return b.select("vec_id", "band", "largest", "nonzero", F.col("extra").cast("long").alias("extra"), R.class_of(F.col("largest"), HEADROOM).alias("class"))


@query("band_energy", f"SELECT vec_id, i // 16 AS band, round(sum(x * x), 6) AS energy, round(max(abs(x)), 6) AS peak FROM ({DIMS_SQL}) GROUP BY ALL")
def band_energy(spark, sf):
    return dims(spark, sf).groupBy("vec_id", F.expr("i div 16").alias("band")).agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("energy"), F.round(F.max(F.abs("x")), 6).alias("peak"))


@query("rotate_pairs", "SELECT a.vec_id, a.i, round((a.x + b.x) * 0.7071067811865476, 6) AS mid, round((a.x - b.x) * 0.7071067811865476, 6) AS side FROM (" + DIMS_SQL + ") a JOIN (" + DIMS_SQL + ") b ON a.vec_id = b.vec_id AND b.i = a.i + 32 WHERE a.i < 32")
def rotate_pairs(spark, sf):
    e = F.col("embedding").cast("array<double>")
    both = F.zip_with(F.slice(e, 1, 32), F.slice(e, 33, 32), lambda a, b: F.struct(F.round((a + b) * 0.7071067811865476, 6).alias("mid"), F.round((a - b) * 0.7071067811865476, 6).alias("side")))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(both).alias("i", "p")).select("vec_id", "i", "p.mid", "p.side")


def _dct_sql() -> str:
    return f"SELECT vec_id, k, round(sum(x * {sqrt(2 / 64)!r} * cos({pi!r} / 64 * (i + 0.5) * (k + 0.5))), 5) AS y FROM ({DIMS_SQL}), (SELECT unnest(range(0, 64)) AS k) GROUP BY vec_id, k"


@query("dct4_embeddings", _dct_sql())
def dct4_embeddings(spark, sf):
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(T.dct4(np.stack(v.to_list()).astype(float)))) if len(v) else pd.Series([], dtype=object)

    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(run("embedding")).alias("k", "y")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("y", 5).alias("y"))


@query("mdct_round_trip", f"SELECT user_id, n, round(x::DOUBLE, 4) AS y FROM ({SIGNAL_SQL})")
def mdct_round_trip(spark, sf):
    """Analysis and synthesis of each user's signal give the signal back where two frames overlap: everywhere."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    s = signal(spark, sf).select("user_id", (F.row_number().over(w) - 1).cast("long").alias("n"), "x")
    y = T.synthesise(T.analyse(s, 16, ["user_id"]), 16, ["user_id"])
    return s.join(y, ["user_id", "n"]).select("user_id", "n", F.round("y", 4).alias("y"))


#: A grid of steps g, each 2 ** (g / 4) / 256.
GRID = range(0, 24, 2)
_CURVE_SQL = f"""
    WITH s AS (SELECT unnest({list(GRID)}) AS g), q AS (SELECT vec_id, g, x, pow(2, g / 4.0) / 256 AS step FROM ({DIMS_SQL}), s),
    m AS (SELECT vec_id, g, x, step, ({_quant_sql('step')})::BIGINT AS m FROM q)
    SELECT vec_id, g, sum(2 * length(bin(m + 1)) - 1 + (m <> 0)::INT)::DOUBLE AS r, sum(pow(abs(x) - CASE WHEN m = 0 THEN 0 ELSE (m - 0.1875) * step END, 2)) AS d, count(*) FILTER (m <> 0) * 22 AS c FROM m GROUP BY vec_id, g
"""


def curves(spark, sf):
    """Bits, distortion and cycles of every frame at every step."""
    at = dims(spark, sf).withColumn("g", F.explode(F.array(*[F.lit(g) for g in GRID]))).withColumn("step", F.pow(F.lit(2.0), F.col("g") / 4.0) / 256)
    q = at.withColumn("m", R.quantise(F.col("x"), F.col("step")))
    error = F.abs("x") - F.when(F.col("m") == 0, 0.0).otherwise((F.col("m") - 0.1875) * F.col("step"))
    return q.groupBy("vec_id", "g").agg(F.sum(B.golomb_bits("m", 0) + (F.col("m") != 0).cast("int")).cast("double").alias("r"), F.sum(error * error).alias("d"), (F.count_if(F.col("m") != 0) * 22).alias("c"))


@query("rate_curve", f"SELECT vec_id, g, r, round(d, 9) AS d, c FROM ({_CURVE_SQL})")
def rate_curve(spark, sf):
    return curves(spark, sf).select("vec_id", "g", "r", F.round("d", 9).alias("d"), "c")


@query("rate_curve_argmin", f"SELECT vec_id, g, r FROM ({_CURVE_SQL}) WHERE c <= 1400 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d + 0.0001 * r, g) = 1")
def rate_curve_argmin(spark, sf):
    return R.pick(curves(spark, sf), "vec_id", 0.0001, 1400).select("vec_id", "g", "r")


_LAMBDAS = [10 ** (-6 + i / 4) for i in range(17)]


@query(
    "lambda_grid",
    f"""WITH c AS ({_CURVE_SQL}), l AS (SELECT unnest({_LAMBDAS!r}) AS lam), p AS (SELECT lam, vec_id, r FROM c, l QUALIFY row_number() OVER (PARTITION BY lam, vec_id ORDER BY d + lam * r, g) = 1)
        SELECT round(lam, 12) AS lam, sum(r) AS bits, count(*) AS frames FROM p GROUP BY lam""",
)
def lambda_grid(spark, sf):
    """Total bits at each lambda: one pass over the curves for the whole grid."""
    picks = [F.min(F.struct((F.col("d") + l * F.col("r")).alias("j"), "g", "r"))["r"].alias(f"r{i}") for i, l in enumerate(_LAMBDAS)]
    total = curves(spark, sf).groupBy("vec_id").agg(*picks).agg(*[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(_LAMBDAS))], F.count(F.lit(1)).alias("frames"))
    rows = F.explode(F.array(*[F.struct(F.round(F.lit(l), 12).alias("lam"), F.col(f"r{i}").alias("bits")) for i, l in enumerate(_LAMBDAS)]))
    return total.select(rows.alias("x"), "frames").select("x.lam", "x.bits", "frames")


_FRAME_PICK = "list_sort(list_transform(f, lambda p: struct_pack(j := p.d + exp(mid) * p.r, g := p.g, r := p.r)))[1].r"


@query(
    "lambda_allocate",
    f"""WITH RECURSIVE c AS MATERIALIZED ({_CURVE_SQL}), a AS MATERIALIZED (SELECT list(f) AS frames, count(*) AS n FROM (SELECT vec_id, list(struct_pack(g := g, r := r, d := d)) AS f FROM c GROUP BY vec_id)),
        s AS (SELECT 0 AS i, {R.LOW}::DOUBLE AS lo, {R.HIGH}::DOUBLE AS hi
              UNION ALL SELECT i + 1, CASE WHEN bits > target THEN mid ELSE lo END, CASE WHEN bits > target THEN hi ELSE mid END
              FROM (SELECT i, lo, hi, mid, (250.0 - {R.SIDE_BITS}) * n AS target, list_sum(list_transform(frames, lambda f: {_FRAME_PICK})) AS bits FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE i < {R.STEPS}), a))
        SELECT vec_id, g, r FROM c, (SELECT exp(hi) AS lam FROM s WHERE i = {R.STEPS}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d + lam * r, g) = 1""",
)
def lambda_allocate(spark, sf):
    """The choice of steps that just fits 250 bits a frame, by grids of lambdas; the SQL bisects."""
    from strandline.session import materialize

    c = materialize(curves(spark, sf), "curves")
    return R.allocate(c, "vec_id", 250.0 * c.select("vec_id").distinct().count())[1].select("vec_id", "g", "r")


_PATHS_SQL = " + ".join(f"abs(log2(list_sum(list_transform(x[{16 * b + 1}:{16 * b + 16}], lambda v: v * v)) + 1e-9) + 6 - 2 * c{b})" for b in range(4))


@query(
    "viterbi_classes",
    f"""WITH k AS (SELECT unnest(range(0, 4)) AS c), p AS (SELECT a.c AS c0, b.c AS c1, d.c AS c2, e.c AS c3 FROM k a, k b, k d, k e),
        t AS (SELECT vec_id, [c0, c1, c2, c3] AS path, 0.5 * c0 + 3.0 * ((c0 <> c1)::INT + (c1 <> c2)::INT + (c2 <> c3)::INT) + {_PATHS_SQL} AS cost FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p)
        SELECT vec_id, path::INT[] AS path, round(cost, 6) AS cost FROM t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(cost, 9), list_reverse(path)) = 1""",
)
def viterbi_classes(spark, sf):
    """Cheapest class of each of the four bands when changes of class cost 3; the SQL tries every path."""
    e = F.col("embedding").cast("array<double>")
    bands = [F.aggregate(F.slice(e, 16 * b + 1, 16), F.lit(0.0), lambda a, x: a + x * x) for b in range(4)]
    costs = F.array(*[F.abs(F.log2(band + 1e-9) + 6 - 2 * k) for band in bands for k in range(4)])
    moves = 3.0 * (1 - np.eye(4))
    found = R.best_paths(table(spark, sf, "embeddings").select("vec_id", costs.alias("costs")), "vec_id", "costs", moves, np.arange(4) * 0.5)
    return found.withColumn("cost", F.round("cost", 6))


# the codec


def _album(spark, sf):
    """An album of all events in order: two tones, and on one side the events' values."""
    from strandline.operators.lookup import numbered

    s = numbered(table(spark, sf, "events").select("event_id", "value"), "event_id", "i")
    left = F.round(8000 * F.sin(F.col("i") * 0.031) + 2000 * F.sin(F.col("i") * 0.21))
    return s.select("i", left.alias("left"), (0.8 * left + F.round("value")).alias("right"))


@query(
    "album_codec",
    """WITH n AS (SELECT count(*) AS n FROM events) SELECT n AS samples, (n + 511) // 512 + 1 AS frames, (((n + 511) // 512 + 1) + 255) // 256 AS seeks, 2::BIGINT AS tracks, true AS fits, true AS good, true AS seekable FROM n""",
)
def album_codec(spark, sf):
    """Encode to 700 bits a frame, decode, and compare: within the budget, over 20 dB, and a late track the same as in the whole."""
    from strandline.operators import codec
    from strandline.session import materialize
    from strandline.sources import containers, uli

    signal = materialize(_album(spark, sf), "album")
    n = signal.count()
    tracks = [{"start_sample": 0, "samples": n // 3, "title": "One", "artist": "A"}, {"start_sample": n // 3, "samples": n - n // 3, "title": "Two", "artist": "A"}]
    frames = -(-n // 512) + 1
    blob = codec.encode(signal, n, 700.0 * frames, tracks, stride=24, width=2, train=False)
    m = containers.parse_ula2(blob)
    files = spark.createDataFrame([("album", blob)], "path string, content binary")
    bits = uli.read_symbols(files).agg(F.sum("bits")).first()[0]
    whole = codec.decoded(files).select("i", F.col("left").alias("l"), F.col("right").alias("r"))
    late = codec.decoded(files, 1).select((F.col("i") + n // 3).alias("i"), F.col("left").alias("ll"), F.col("right").alias("lr"))
    each = signal.join(whole, "i", "full").join(late, "i", "full")
    square = lambda x, y: F.sum(x * x + y * y)
    found = each.agg(
        square(F.col("left"), F.col("right")).alias("x"), square(F.col("left") - F.col("l"), F.col("right") - F.col("r")).alias("e"),
        F.count_if(F.col("left").isNotNull() & F.col("l").isNotNull()).alias("both"), F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("ll").eqNullSafe(F.col("l")) & F.col("lr").eqNullSafe(F.col("r")) & (F.col("i") >= n // 3) | F.col("ll").isNull() & (F.col("i") < n // 3)).alias("same"),
    ).first()
    whole_read = found["both"] == found["rows"] == n
    good = whole_read and (not found["e"] or found["x"] > 100 * found["e"])  # over 20 dB
    row = (n, m["header"]["frames"], m["header"]["seeks"], len(m["tracks"]), bits <= 700 * frames, bool(good), whole_read and found["same"] == n)
    return spark.createDataFrame([row], "samples long, frames long, seeks long, tracks long, fits boolean, good boolean, seekable boolean")


@query("synthesis_fixed", "SELECT vec_id, true AS close, true AS eight_is_high_byte FROM embeddings")
def synthesis_fixed(spark, sf):
    """The 32-bit synthesis of vectors as the lowest coefficients of a frame, against the same transform in floating point."""

    @F.pandas_udf("struct<close:boolean,eight:boolean>")
    def run(values: pd.Series) -> pd.DataFrame:
        from strandline.operators import codec, fixed

        x = np.zeros((len(values), fixed.HOP))
        x[:, :64] = np.stack(values.to_list()) * 3e6
        x = np.round(x)
        rows = []
        for row in x:
            frames = np.stack([row, np.zeros(fixed.HOP)])
            eight, sixteen, _ = fixed.overlap(fixed.imdct(frames.astype(np.int64)))
            back = T.imdct(frames / codec.analysis_scale()) * T.sine_window(fixed.HOP)
            plain = np.concatenate([back[0, : fixed.HOP], back[0, fixed.HOP :]])
            rows.append((bool(np.abs(plain - sixteen.ravel()).max() <= 3), bool(np.abs(eight.ravel() - sixteen.ravel() / 256).max() <= 1)))
        return pd.DataFrame(rows, columns=["close", "eight"])

    return table(spark, sf, "embeddings").select("vec_id", run("embedding").alias("r")).select("vec_id", "r.close", F.col("r.eight").alias("eight_is_high_byte"))


@query("quantiser_units", "SELECT g, ms, (floor(pow(2, (g - 4 * ms) / 8.0) + 0.5))::BIGINT AS step, round(floor(pow(2, (g - 4 * ms) / 8.0) + 0.5) * CASE WHEN ms = 1 THEN 1.4142135623730951 ELSE 1 END / 16, 9) AS unit, greatest(1, least(65535, (268435456 // floor(pow(2, (g - 4 * ms) / 8.0) + 0.5)::BIGINT) // 16 - 1))::BIGINT AS largest FROM (SELECT unnest(range(8, 188)) AS g), (SELECT unnest([0, 1]) AS ms)")
def quantiser_units(spark, sf):
    """Step, reconstruction unit and largest magnitude of every step, for both kinds of frames."""
    from strandline.operators import fixed

    steps = F.array(*[F.lit(int(v)) for v in fixed.steps()])
    q = spark.range(8, 188).select(F.col("id").alias("g"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ms")).withColumn("step", F.get(steps, (F.col("g") - 4 * F.col("ms")).cast("int")).cast("long"))
    return q.select("g", "ms", "step", F.round(F.col("step") * F.when(F.col("ms") == 1, sqrt(2)).otherwise(1.0) / 16, 9).alias("unit"), B.largest_magnitude("step").alias("largest"))
