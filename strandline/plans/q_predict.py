"""Prediction, entropy cost, stereo and waveform queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import bits as B
from strandline.functions import waves as W
from strandline.operators import predict as P
from strandline.plans.registry import query
from strandline.session import table

#: The signal of a user: prices in cents, in the order of their events.
SIGNAL_SQL = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, cast(round(value * 100) as bigint) AS x FROM events"
BLOCK_SQL = f"SELECT user_id, n // 16 AS blk, n % 16 AS i, x FROM ({SIGNAL_SQL})"


def signal(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("x"))


def blocked(spark, sf, size=16):
    return P.blocks(signal(spark, sf), "user_id", "event_id", size).select("user_id", "blk", "i", "x")


def _residual_sql(order: int) -> str:
    parts = " ".join(f"- ({c}) * lag(x, {k}) OVER w" for k, c in enumerate(P.FIXED[order], 1))
    return f"SELECT user_id, blk, i, e FROM (SELECT user_id, blk, i, x {parts} AS e FROM ({BLOCK_SQL}) WINDOW w AS (PARTITION BY user_id, blk ORDER BY i)) WHERE i >= {order}"


def _residual(order: int):
    def run(spark, sf):
        return P.fixed_residual(blocked(spark, sf), order, ["user_id", "blk"]).select("user_id", "blk", "i", "e")

    return run


def _integrated(order: int):
    def run(spark, sf):
        by = ["user_id", "blk"]
        return P.integrate_fixed(P.warm_residual(blocked(spark, sf), order, by), order, by).select("user_id", "blk", "i", "x", F.col("y").alias("back"), (F.col("x") == F.col("y")).alias("same"))

    return run


for _o in range(5):
    query(f"fixed_residual_o{_o}", _residual_sql(_o))(_residual(_o))
    query(f"fixed_integrate_o{_o}", f"SELECT user_id, blk, i, x, x AS back, true AS same FROM ({BLOCK_SQL})")(_integrated(_o))

_ALL_SQL = " UNION ALL ".join(f"SELECT user_id, blk, i, {o} AS ord, e FROM ({_residual_sql(o)})" for o in range(5))
_COST_SQL = f"""
    SELECT user_id, blk, ord, k, sum(((CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END) >> k) + 1 + k) + 17 * ord AS bits
    FROM ({_ALL_SQL}), (SELECT unnest(range(0, 15)) AS k) GROUP BY user_id, blk, ord, k
"""


@query(
    "best_fixed_rice",
    f"""SELECT user_id, blk, ord::BIGINT AS ord, k, bits::BIGINT AS bits FROM ({_COST_SQL}) QUALIFY row_number() OVER (PARTITION BY user_id, blk ORDER BY bits, ord, k) = 1""",
)
def best_fixed_rice(spark, sf):
    """Cheapest order and Rice parameter of each block; warm-up samples cost 17 bits each."""
    e = P.all_fixed_residuals(blocked(spark, sf), ["user_id", "blk"])
    costs = P.rice_costs(e, ["user_id", "blk", "ord"]).withColumn("bits", F.col("bits") + 17 * F.col("ord"))
    return P.first_least(costs, ["user_id", "blk"], ["bits", "ord", "k"]).select("user_id", "blk", F.col("ord").cast("long").alias("ord"), F.col("k").cast("long").alias("k"), "bits")


@query(
    "rice_partition_cost",
    f"""WITH e AS ({_residual_sql(2)}), p AS (SELECT *, i // (16 >> p) AS part FROM e, (SELECT unnest([0, 1, 2]) AS p)),
        c AS (SELECT user_id, blk, p, part, k, sum(((CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END) >> k) + 1 + k) AS bits FROM p, (SELECT unnest(range(0, 15)) AS k) GROUP BY ALL),
        b AS (SELECT user_id, blk, p, part, min(bits) AS bits FROM c GROUP BY ALL)
        SELECT user_id, blk, p::INT AS p, (sum(bits) + 5 * count(*))::BIGINT AS bits, count(*) AS parts FROM b GROUP BY ALL""",
)
def rice_partition_cost(spark, sf):
    """Bits of a block under 1, 2 and 4 Rice partitions, each with its best parameter and 5 bits of header."""
    e = P.fixed_residual(blocked(spark, sf), 2, ["user_id", "blk"]).withColumn("p", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    parts = e.withColumn("part", F.expr("i div shiftright(16, p)"))
    best = P.rice_costs(parts, ["user_id", "blk", "p", "part"]).groupBy("user_id", "blk", "p", "part").agg(F.min("bits").alias("bits"))
    return best.groupBy("user_id", "blk", "p").agg((F.sum("bits") + 5 * F.count(F.lit(1))).alias("bits"), F.count(F.lit(1)).alias("parts"))


@query(
    "wasted_bits_per_block",
    """WITH c AS (SELECT o_custkey, bit_or(cast(round(o_totalprice * 100) as bigint) * 8) AS b FROM orders GROUP BY o_custkey)
       SELECT o_custkey, CASE WHEN b <> 0 THEN length(bin(b)) - length(rtrim(bin(b), '0')) END AS wasted FROM c""",
)
def wasted_bits_per_block(spark, sf):
    return P.wasted_bits(table(spark, sf, "orders").select("o_custkey", (F.round(F.col("o_totalprice") * 100).cast("long") * 8).alias("x")), ["o_custkey"])


@query(
    "stereo_round_trip",
    f"""WITH s AS (SELECT user_id, n, x AS l, coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY n), 0) AS r FROM ({SIGNAL_SQL}))
        SELECT user_id, n, m AS mode, CASE m WHEN 'independent' THEN l WHEN 'left_side' THEN l WHEN 'side_right' THEN l - r ELSE (l + r) >> 1 END AS a, CASE WHEN m IN ('independent', 'side_right') THEN r ELSE l - r END AS b, l AS l2, r AS r2
        FROM s, (SELECT unnest(['independent', 'left_side', 'side_right', 'mid_side']) AS m)""",
)
def stereo_round_trip(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = signal(spark, sf).select("user_id", (F.row_number().over(w) - 1).cast("long").alias("n"), F.col("x").alias("l"), F.coalesce(F.lag("x").over(w), F.lit(0)).alias("r"))
    rows = []
    for mode, (a, b) in P.decorrelate(F.col("l"), F.col("r")).items():
        l2, r2 = P.recombine(mode, a, b)
        rows.append(F.struct(F.lit(mode).alias("mode"), a.cast("long").alias("a"), b.cast("long").alias("b"), l2.cast("long").alias("l2"), r2.cast("long").alias("r2")))
    return s.select("user_id", "n", F.explode(F.array(*rows)).alias("m")).select("user_id", "n", "m.*")


LPC, LPC_SHIFT = [29, -17, 5], 4


@query(
    "lpc_residual",
    f"""SELECT user_id, blk, i, CASE WHEN i < 3 THEN x ELSE x - ((29 * lag(x, 1) OVER w - 17 * lag(x, 2) OVER w + 5 * lag(x, 3) OVER w) >> 4) END AS e FROM ({BLOCK_SQL}) WINDOW w AS (PARTITION BY user_id, blk ORDER BY i)""",
)
def lpc_residual(spark, sf):
    return P.lpc_residual(blocked(spark, sf), LPC, LPC_SHIFT, ["user_id", "blk"]).select("user_id", "blk", "i", "e")


@query("lpc_integrate", f"SELECT user_id, blk, list(x ORDER BY i) AS samples FROM ({BLOCK_SQL}) GROUP BY user_id, blk")
def lpc_integrate(spark, sf):
    e = P.lpc_residual(blocked(spark, sf), LPC, LPC_SHIFT, ["user_id", "blk"])
    each = e.groupBy("user_id", "blk").agg(F.array_sort(F.collect_list(F.struct("i", "e"))).alias("r")).select("user_id", "blk", F.col("r.e").alias("residuals"))  # at most 16 samples a block
    return P.integrate_lpc(each, LPC, LPC_SHIFT).select("user_id", "blk", "samples")


@query("fixed_wrapped_o2", f"SELECT user_id, blk, i, ((x * 100003 + 2147483648) & 4294967295) - 2147483648 AS y FROM ({BLOCK_SQL})")
def fixed_wrapped_o2(spark, sf):
    """Second-order integration in 32-bit arithmetic, of samples that pass its range."""
    by = ["user_id", "blk"]
    wide = blocked(spark, sf).withColumn("x", F.col("x") * 100003)
    return P.integrate_fixed_wrapped(P.warm_residual(wide, 2, by), 2, by).select("user_id", "blk", "i", "y")


@query("lpc_wrapped", f"SELECT user_id, blk, list(((x * 70001 + 2147483648) & 4294967295) - 2147483648 ORDER BY i) AS samples FROM ({BLOCK_SQL}) GROUP BY user_id, blk")
def lpc_wrapped(spark, sf):
    """A first-order predictor of weight 1 in 32-bit arithmetic, of samples that pass its range."""
    e = P.lpc_residual(blocked(spark, sf).withColumn("x", F.col("x") * 70001), [1], 0, ["user_id", "blk"])
    each = e.groupBy("user_id", "blk").agg(F.array_sort(F.collect_list(F.struct("i", "e"))).alias("r")).select("user_id", "blk", F.col("r.e").alias("residuals"))
    return P.integrate_lpc(each, [1], 0, bits=32).select("user_id", "blk", "samples")


@query("recipe_applied", """WITH s AS (SELECT user_id, event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, value AS x FROM events), w AS (SELECT i - 100 AS i, x, (SELECT max(i) - 99 FROM s WHERE i < 4000) AS n FROM s WHERE i >= 100 AND i < 4000)
       SELECT i, round(x * 0.5 * least(1.0, (n - i) / 200.0), 6) AS x FROM w""")
def recipe_applied(spark, sf):
    """Trim, gain and a fade at the end of one signal, by a recipe of seconds."""
    from strandline.operators.lookup import numbered
    from strandline.sources.textual import apply_recipe

    s = numbered(table(spark, sf, "events").select("event_id", F.col("value").alias("x")), "event_id", "i").select("i", "x")
    return apply_recipe(s, "i", "x", 100, 1.0, 40.0, 2.0, 0.5).select("i", F.round("x", 6).alias("x"))


@query("lpc_accumulator", "SELECT p_partkey, (p_size + p_partkey % 4096 + 17) * 32768 <= 2147483647 AS fits FROM part")
def lpc_accumulator(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", P.accumulator_fits(F.array(F.col("p_size").cast("long"), -(F.col("p_partkey") % 4096), F.lit(17).cast("long")), 16).alias("fits"))


@query("delta_steps", f"SELECT user_id, n, x % 192 AS g, x % 192 - lag(x % 192, 1, 0) OVER (PARTITION BY user_id ORDER BY n) AS delta, x % 192 AS back FROM ({SIGNAL_SQL})")
def delta_steps(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    g = signal(spark, sf).select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("n"), (F.col("x") % 192).alias("g"))
    d = g.withColumn("delta", F.col("g") - F.lag("g", 1, 0).over(w))
    return d.withColumn("back", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("user_id", "n", "g", "delta", "back")


@query(
    "track_timeline",
    """WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations)
       SELECT conv_id, turn, n, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (n + 511) // 512 + 1 AS frames FROM t""",
)
def track_timeline(spark, sf):
    """Gapless assembly: every track begins where the one before it ends."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return t.select("conv_id", "turn", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"), F.expr("(n + 511) div 512 + 1").alias("frames"))


@query("chunk_ntile", "SELECT user_id, event_id, ntile(7) OVER (PARTITION BY user_id ORDER BY event_id) AS worker FROM events")
def chunk_ntile(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.ntile(7).over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("worker"))


@query(
    "synth_waveforms",
    """SELECT i, abs(i % 64 - 32) * 2 - 32 AS tri, CASE WHEN i % 50 < 12 THEN 1000 ELSE -1000 END AS square, (((i * 2654435761) & 4294967295) >> 16) - 32768 AS hash, (i * 40503) % 97 - 48 AS noise,
              CASE WHEN i % 441 = 0 THEN 30000 ELSE 0 END AS impulse, (i * 65536 * 3) & 4294967295 AS phase, CASE WHEN (i // 8192) % 2 = 0 THEN 255 ELSE 16 END AS level FROM (SELECT unnest(range(0, 20000)) AS i)""",
)
def synth_waveforms(spark, sf):
    """Test signals in closed form over a range: the phase of a sum is a product here, so no window is needed."""
    i = F.col("i")
    return spark.range(20000).select(F.col("id").alias("i")).select(
        "i", W.triangle(i).alias("tri"), W.square(i).alias("square"), W.scrambled(i).alias("hash"), W.hash_noise(i).alias("noise"), W.impulses(i).alias("impulse"), W.phase(i, 65536 * 3).alias("phase"), W.loud_quiet(i).alias("level")
    )


def _wave_sql(weight: str, wave: str) -> str:
    return f"floor({weight} * ({wave}) / 1000.0)::BIGINT"


_CENTRE_SQL = " + ".join((_wave_sql("7000", "abs(i % 64 - 32) * 2 - 32"), _wave_sql("3000", "abs(i % 40 - 20) * 2 - 20"), _wave_sql("2", "CASE WHEN i % 32 < 16 THEN 1000 ELSE -1000 END")))
_SIDE_SQL = _wave_sql("1500", "abs(i % 90 - 45) * 2 - 45") + " + (i * 7919) % 31 - 15"


@query(
    "synth_pair",
    f"""WITH s AS (SELECT i, {_CENTRE_SQL} AS c, {_SIDE_SQL} AS d FROM (SELECT unnest(range(0, 20000)) AS i))
        SELECT i, c + d + (i * 104729) % 17 - 8 AS "left", c - d + (i * 15485863) % 17 - 8 AS "right" FROM s""",
)
def synth_pair(spark, sf):
    """Correlated stereo: a shared centre, a side of opposite signs, and noise of each channel's own."""
    left, right = W.correlated_pair(F.col("id"), {64: 7000, 40: 3000}, 90, 1500, (31, 17))
    return spark.range(20000).select(F.col("id").alias("i"), left.alias("left"), right.alias("right"))


@query("adversarial_tones", "SELECT i, round(least(20000, greatest(-20000, 30000 * (sin(i * 0.05) + sin(i * 0.15) / 3 + sin(i * 0.25) / 5))), 6) AS clipped, round(9000 * sin(i * 0.031) + 9000 * sin(i * 0.047), 6) AS pair FROM (SELECT unnest(range(0, 5000)) AS i)")
def adversarial_tones(spark, sf):
    i = F.col("id")
    return spark.range(5000).select(i.alias("i"), F.round(W.harmonics(i, 0.05, 30000.0, 20000.0), 6).alias("clipped"), F.round(W.tones(i, (9000.0, 0.031), (9000.0, 0.047)), 6).alias("pair"))


@query("noise_blocks", "SELECT 0 AS part, 100000 AS samples, 25000 AS blocks, true AS held, true AS inside, true AS spread UNION ALL SELECT 1, 34464, 8616, true, true, true")
def noise_blocks(spark, sf):
    """Seeded noise held for four samples: what must hold of it, as its values are a generator's."""
    x = W.block_noise(spark, 134464, 9000.0, 20261116).withColumn("part", F.expr("int(i div 100000)"))
    b = x.groupBy("part", F.expr("i div 4").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return b.groupBy("part").agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("blocks"), F.bool_and(F.col("lo") == F.col("hi")).alias("held"), F.bool_and(F.abs("lo") <= 9000).alias("inside"), (F.stddev("lo") > 5000).alias("spread"))


@query(
    "resample_three_halves",
    f"""WITH s AS ({SIGNAL_SQL}), len AS (SELECT user_id, count(*) * 3 // 2 AS m FROM s GROUP BY user_id), o AS (SELECT user_id, unnest(range(0, m)) AS j FROM len),
        t AS (SELECT o.user_id, j, j * 2 // 3 + k AS n, CASE (j * 2 % 3) * 10 + k WHEN 0 THEN 12 WHEN 1 THEN 0 WHEN 10 THEN 8 WHEN 11 THEN 4 WHEN 20 THEN 4 ELSE 8 END AS tap FROM o, (SELECT unnest([0, 1]) AS k))
        SELECT t.user_id, j, sum(tap * coalesce(x, 0))::BIGINT AS y FROM t LEFT JOIN s ON s.user_id = t.user_id AND s.n = t.n GROUP BY t.user_id, j""",
)
def resample_three_halves(spark, sf):
    """Rational resampling as a tap join: output j takes inputs j * down div up + k with the weights of its phase; outside is 0."""
    from strandline.operators.transform import resample_taps

    s = P.blocks(signal(spark, sf), "user_id", "event_id", 1 << 40).select("user_id", F.col("i").alias("n"), "x")
    return resample_taps(s, 3, 2, {0: (12, 0), 1: (8, 4), 2: (4, 8)}, ["user_id"], "n", "x")


@query("kaiser_bessel", "SELECT p_size, round(list_reduce(list_prepend(1.0, list_transform(range(1, 40), lambda k: pow(pow(p_size / 20.0, k) / list_product(list_transform(range(1, k + 1), lambda j: j::DOUBLE)), 2))), lambda a, b: a + b), 6) AS i0 FROM part GROUP BY p_size")
def kaiser_bessel(spark, sf):
    """Modified Bessel function of order 0 by 39 terms of its series, as a fold in the row."""
    half = F.col("p_size") / 20.0
    step = F.aggregate(F.sequence(F.lit(1), F.lit(39)), F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")), lambda a, k: F.struct((a["s"] + F.pow(a["t"] * half / k, F.lit(2.0))).alias("s"), (a["t"] * half / k).alias("t")), lambda a: a["s"])
    return table(spark, sf, "part").select("p_size").distinct().select("p_size", F.round(step, 6).alias("i0"))
