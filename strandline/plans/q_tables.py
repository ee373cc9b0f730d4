"""Lookups, aggregations, validations and code tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import bits as B
from strandline.operators import lookup as L
from strandline.operators import stats as S
from strandline.plans.q_predict import BLOCK_SQL, SIGNAL_SQL, _residual_sql, best_fixed_rice, blocked, signal
from strandline.plans.registry import query
from strandline.session import table

# lookups


@query(
    "seek_asof",
    """SELECT e.event_id, p.event_id AS point, e.event_id - p.event_id AS skip FROM events e ASOF LEFT JOIN (SELECT event_id FROM events WHERE event_id % 257 = 3) p ON e.event_id >= p.event_id""",
)
def seek_asof(spark, sf):
    """The last seek point at or before each target. Targets are dealt out in ranges, so no task orders all rows."""
    e = table(spark, sf, "events").select("event_id")
    points = e.where("event_id % 257 = 3").select("event_id", F.col("event_id").alias("point"))
    return L.asof_all(e, points, "event_id", ["point"]).select("event_id", "point", (F.col("event_id") - F.col("point")).alias("skip"))


@query(
    "seek_asof_by_user",
    """SELECT e.event_id, e.user_id, p.event_id AS point, p.value FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id""",
)
def seek_asof_by_user(spark, sf):
    e = table(spark, sf, "events")
    p = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("point"), "value")
    return L.asof(e.select("event_id", "user_id"), p, ["user_id"], "event_id", ["point", "value"])


@query(
    "seek_entry",
    """SELECT e.event_id, e.event_id // 256 AS entry, s.first AS entry_event, s.n AS entry_size FROM events e JOIN (SELECT event_id // 256 AS entry, min(event_id) AS first, count(*) AS n FROM events GROUP BY 1) s ON s.entry = e.event_id // 256""",
)
def seek_entry(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr("event_id div 256").alias("entry"))
    index = e.groupBy("entry").agg(F.min("event_id").alias("entry_event"), F.count(F.lit(1)).alias("entry_size"))
    return e.join(index, "entry").select("event_id", "entry", "entry_event", "entry_size")


_TRACKS_SQL = "SELECT row_number() OVER (ORDER BY s) - 1 AS track, s AS start, lead(s, 1, 1000000000000) OVER (ORDER BY s) AS stop FROM (SELECT DISTINCT event_id AS s FROM events WHERE event_id % 331 = 0)"


@query("frame_to_track", f"SELECT e.event_id, t.track, e.event_id - t.start AS pos FROM events e JOIN ({_TRACKS_SQL}) t ON e.event_id >= t.start AND e.event_id < t.stop")
def frame_to_track(spark, sf):
    """Range lookup of a place on the track timeline."""
    e = table(spark, sf, "events").select("event_id")
    starts = e.where("event_id % 331 = 0").distinct()
    w = Window.orderBy("event_id")  # one row a track
    tracks = starts.select((F.row_number().over(w) - 1).cast("long").alias("track"), F.col("event_id").alias("start"), F.lead("event_id", 1, 1000000000000).over(w).alias("stop"))
    return L.range_of(e, tracks, "event_id", "start", "stop", ["track"]).select("event_id", "track", (F.col("event_id") - F.col("start")).alias("pos"))


#: Measured decode rows by block size, predictor kind and order.
MEASURED = [{"id": i, "block": b, "kind": k, "ord": o} for i, (b, k, o) in enumerate(((2048, "fixed", 0), (2048, "fixed", 2), (2048, "lpc", 4), (4096, "fixed", 2), (4096, "lpc", 8)))]


@query(
    "nearest_measured",
    """WITH q AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2048 ELSE 4096 END AS block, CASE WHEN p_partkey % 3 = 0 THEN 'lpc' ELSE 'fixed' END AS kind, p_size % 12 AS ord FROM part),
       d AS (SELECT * FROM (VALUES """
    + ", ".join(f"({d['id']}, {d['block']}, '{d['kind']}', {d['ord']})" for d in MEASURED)
    + """) AS d(id, dblock, dkind, dord))
       SELECT p_partkey, id AS measured FROM q, d QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY block <> dblock, kind <> dkind, abs(ord - dord), id) = 1""",
)
def nearest_measured(spark, sf):
    q = table(spark, sf, "part").select("p_partkey", F.expr("case when p_size % 2 = 0 then 2048 else 4096 end").alias("block"), F.expr("case when p_partkey % 3 = 0 then 'lpc' else 'fixed' end").alias("kind"), F.expr("p_size % 12").alias("ord"))

    def score(d):
        return [(F.col("block") != d["block"]).cast("int"), (F.col("kind") != d["kind"]).cast("int"), F.abs(F.col("ord") - d["ord"])]

    return L.nearest(q, MEASURED, score, ["id"]).select("p_partkey", F.col("id").alias("measured"))


@query("content_alias", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS blob, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) <> doc_id AS alias FROM documents")
def content_alias(spark, sf):
    """Identical contents share the first one's blob; the digest is aggregated first, so a hot content is one row a task."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("blob"))
    return d.join(first, "digest").select("doc_id", "blob", (F.col("blob") != F.col("doc_id")).alias("alias"))


@query("referenced_strings", "SELECT n_nationkey, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AS referenced FROM nation")
def referenced_strings(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey")
    used = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return n.join(used, "n_nationkey", "left_semi").withColumn("referenced", F.lit(True)).union(n.join(used, "n_nationkey", "left_anti").withColumn("referenced", F.lit(False)))


@query(
    "string_pool",
    """WITH f AS (SELECT c_mktsegment AS s, min(c_custkey) AS first FROM customer GROUP BY 1), p AS (SELECT s, coalesce(sum(strlen(s) + 1) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM f)
       SELECT c_custkey, o AS "offset" FROM customer JOIN p ON s = c_mktsegment""",
)
def string_pool(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return L.intern(c, "c_mktsegment", "c_custkey")[1].select("c_custkey", "offset")


@query(
    "alignment_signal",
    f"""WITH s AS (SELECT user_id, n, x // 500 AS x FROM ({SIGNAL_SQL})), m AS (SELECT user_id, count(*) AS m FROM s GROUP BY 1),
            r AS (SELECT s.user_id, n - 3 AS j, x FROM s JOIN m ON m.user_id = s.user_id WHERE n >= 3 AND n < m - least(17, m - 4)), c AS (
            SELECT r.user_id, k AS shift, count(*) AS n, sum((s.x <> r.x)::INT) AS mismatches, max(abs(s.x - r.x)) AS largest FROM r, (SELECT unnest(range(0, 21)) AS k) JOIN s ON s.user_id = r.user_id AND s.n = r.j + k GROUP BY ALL)
        SELECT c.user_id, shift::INT AS shift, mismatches::BIGINT AS mismatches, largest FROM c JOIN (SELECT user_id, count(*) AS m FROM r GROUP BY 1) a ON a.user_id = c.user_id AND a.m = c.n
        QUALIFY row_number() OVER (PARTITION BY c.user_id ORDER BY mismatches, abs(shift - 4), shift) = 1""",
)
def alignment_signal(spark, sf):
    """alignment over whole signals: all from the offset 3 on, less the largest shift at the end, at shifts of 16 around the anchor 4 from 0 on.

    A signal too short for that keeps one sample of reference, and shifts that run past its end don't count.
    """
    w = Window.partitionBy("user_id").orderBy("event_id")
    all_ = Window.partitionBy("user_id")
    s = signal(spark, sf).select("user_id", (F.row_number().over(w) - 1).alias("n"), F.expr("x div 500").alias("x"), F.count(F.lit(1)).over(all_).alias("m"))
    r = s.where("n >= 3 and n < m - least(17, m - 4)").select("user_id", (F.col("n") - 3).alias("n"), "x")
    return L.alignment(s.select("user_id", "n", "x"), r, "user_id", "n", "x", range(21), 4)


@query(
    "pin_compare",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN ['missing left'] WHEN b.k IS NULL THEN ['missing right'] ELSE list_filter([CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.t IS DISTINCT FROM b.t THEN 't' END], lambda x: x IS NOT NULL) END AS reasons
       FROM (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS t FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS t FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) b ON a.k = b.k
       WHERE a.k IS NULL OR b.k IS NULL OR a.n IS DISTINCT FROM b.n OR a.t IS DISTINCT FROM b.t""",
)
def pin_compare(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    one, two = (o.where(c).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("t")) for c in ("o_orderstatus <> 'P'", "o_orderpriority <> '1-URGENT'"))
    return L.compare(one, two, ["k"], ["n", "t"])


@query(
    "first_difference",
    f"""SELECT a.user_id, count(*) AS differing, min(a.n) AS first FROM ({SIGNAL_SQL}) a JOIN (SELECT user_id, n, CASE WHEN x % 7 = 0 THEN x + 1 ELSE x END AS y FROM ({SIGNAL_SQL})) b ON a.user_id = b.user_id AND a.n = b.n WHERE a.x IS DISTINCT FROM b.y GROUP BY a.user_id""",
)
def first_difference(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = signal(spark, sf).select("user_id", (F.row_number().over(w) - 1).cast("long").alias("n"), "x")
    other = s.select("user_id", "n", F.expr("case when x % 7 = 0 then x + 1 else x end").alias("x"))
    return L.compare(s, other, ["user_id", "n"], ["x"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("differing"), F.min("n").alias("first"))


# cost accumulators

_CYCLES_SQL = "SELECT l_orderkey, l_suppkey AS clip, l_shipdate, l_linenumber, CASE WHEN l_partkey % 97 = 0 THEN 4294967295 ELSE cast(round(l_extendedprice * 100) as bigint) END AS c, l_partkey * 10 + l_linenumber AS f FROM lineitem"


def _cycles(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("clip"), "l_linenumber", F.expr("case when l_partkey % 97 = 0 then 4294967295 else cast(round(l_extendedprice * 100) as bigint) end").alias("c"), F.expr("l_partkey * 10 + l_linenumber").alias("f"))




@query("frame_cost", f"SELECT clip, count(*) AS frames, min(c) AS least, min(struct_pack(c := c, f := f)).f AS least_frame, max(c) AS most, -(max(struct_pack(c := c, f := -f)).f) AS most_frame, sum(c)::BIGINT AS total, (sum(c) // count(*))::BIGINT AS mean, bool_or(c = 4294967295) AS wrapped FROM ({_CYCLES_SQL}) GROUP BY clip")
def frame_cost(spark, sf):
    return _cycles(spark, sf).groupBy("clip").agg(*S.cost_columns("c", "f"))


@query("cost_without_wrapped", f"SELECT clip, count(*) FILTER (c <> 4294967295) AS frames, max(c) FILTER (c <> 4294967295) AS most, (sum(c) FILTER (c <> 4294967295) // nullif(count(*) FILTER (c <> 4294967295), 0))::BIGINT AS mean, count(*) FILTER (c = 4294967295) AS wrapped, max(c) FILTER (c <> 4294967295) * 100000 // 33554432 AS worst_x1000 FROM ({_CYCLES_SQL}) GROUP BY clip")
def cost_without_wrapped(spark, sf):
    """The fold that leaves wrapped values out, and the worst share of a budget in thousandths of a percent."""
    whole = "filter (where c <> 4294967295)"
    return _cycles(spark, sf).groupBy("clip").agg(
        F.expr(f"count(*) {whole}").alias("frames"), F.expr(f"max(c) {whole}").alias("most"), F.expr(f"sum(c) {whole} div nullif(count(*) {whole}, 0)").alias("mean"),
        F.expr("count(*) filter (where c = 4294967295)").alias("wrapped"), F.expr(f"max(c) {whole} * 100000 div 33554432").alias("worst_x1000"),
    )


@query("leg_pivot", f"SELECT clip, (sum(c) FILTER (l_linenumber = 1))::BIGINT AS ctrl, (sum(c) FILTER (l_linenumber = 2))::BIGINT AS wide, (sum(c) FILTER (l_linenumber = 3))::BIGINT AS asm, (sum(c) FILTER (l_linenumber = 1) - sum(c) FILTER (l_linenumber = 2))::BIGINT AS gained FROM ({_CYCLES_SQL}) WHERE c <> 4294967295 GROUP BY clip")
def leg_pivot(spark, sf):
    p = _cycles(spark, sf).where("c <> 4294967295").groupBy("clip").pivot("l_linenumber", [1, 2, 3]).agg(F.sum("c"))
    return p.select("clip", F.col("1").alias("ctrl"), F.col("2").alias("wide"), F.col("3").alias("asm"), (F.col("1") - F.col("2")).alias("gained"))


# censuses


def _best_sql():
    from strandline.plans.registry import ORACLES

    return ORACLES["best_fixed_rice"]


@query("subframe_census", f"SELECT ord, count(*) AS n, max(k) AS max_parameter, max(bits) AS max_bits, sum(bits)::BIGINT AS total_bits FROM ({_best_sql()}) GROUP BY ord")
def subframe_census(spark, sf):
    return best_fixed_rice(spark, sf).groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("max_parameter"), F.max("bits").alias("max_bits"), F.sum("bits").alias("total_bits"))


@query("max_order_used", f"SELECT user_id, coalesce(max(ord) FILTER (k > 9), 0) AS max_order FROM ({_best_sql()}) GROUP BY user_id")
def max_order_used(spark, sf):
    return best_fixed_rice(spark, sf).groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("k") > 9, F.col("ord"))), F.lit(0)).cast("long").alias("max_order"))


@query("residual_extremes", f"SELECT user_id, max(abs(e)) AS largest, max(abs(e)) FILTER (i = 2) AS first, bit_or(e) & 1 AS odd, count(*) AS n FROM ({_residual_sql(2)}) GROUP BY user_id")
def residual_extremes(spark, sf):
    from strandline.operators.predict import fixed_residual

    e = fixed_residual(blocked(spark, sf), 2, ["user_id", "blk"])
    return e.groupBy("user_id").agg(F.max(F.abs("e")).alias("largest"), F.max(F.when(F.col("i") == 2, F.abs("e"))).alias("first"), F.bit_or("e").bitwiseAND(F.lit(1).cast("long")).alias("odd"), F.count(F.lit(1)).alias("n"))


@query(
    "warmup_census",
    f"""WITH b AS ({BLOCK_SQL}), t AS (SELECT user_id, blk + 1 AS blk, i - 14 AS i, x AS tail FROM b WHERE i >= 14)
        SELECT b.user_id, count(*) AS warm, count(*) FILTER (t.tail = b.x) AS as_tail, count(*) FILTER (t.tail IS NULL) AS without FROM b LEFT JOIN t ON t.user_id = b.user_id AND t.blk = b.blk AND t.i = b.i WHERE b.i < 2 GROUP BY b.user_id""",
)
def warmup_census(spark, sf):
    """How often a block's first two samples repeat the last two of the block before."""
    b = blocked(spark, sf)
    t = b.where("i >= 14").select("user_id", (F.col("blk") + 1).alias("blk"), (F.col("i") - 14).alias("i"), F.col("x").alias("tail"))
    j = b.where("i < 2").join(t, ["user_id", "blk", "i"], "left")
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("warm"), F.count_if(F.col("tail") == F.col("x")).alias("as_tail"), F.count_if(F.col("tail").isNull()).alias("without"))


@query("colour_set", "SELECT user_id, list_sort(list(DISTINCT rgb)) AS colours FROM (SELECT user_id, ((c >> 16 & 255) >> 3) + (((c >> 8 & 255) >> 3) << 5) + (((c & 255) >> 3) << 10) AS rgb FROM (SELECT user_id, (event_id * 2654435761) & 16777215 AS c FROM events)) GROUP BY user_id")
def colour_set(spark, sf):
    """Distinct 15-bit colours, at most 32,768 a group whatever its rows."""
    c = table(spark, sf, "events").select("user_id", B.rgb15(F.expr("(event_id * 2654435761) & 16777215")).alias("rgb"))
    return c.groupBy("user_id").agg(F.array_sort(F.collect_set("rgb")).alias("colours"))


@query("tile_packing", "SELECT user_id, tile, r AS row, sum((p << (4 * c)))::BIGINT AS packed FROM (SELECT user_id, n // 64 AS tile, (n % 64) // 8 AS r, n % 8 AS c, x % 16 AS p FROM (" + SIGNAL_SQL + ")) GROUP BY ALL")
def tile_packing(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = signal(spark, sf).select("user_id", (F.row_number().over(w) - 1).cast("long").alias("n"), "x")
    return s.groupBy("user_id", F.expr("n div 64").alias("tile"), F.expr("(n % 64) div 8").alias("row")).agg(F.sum(F.expr("shiftleft(x % 16, int(4 * (n % 8)))")).alias("packed"))


# verdicts


@query(
    "verdict_reasons",
    f"""WITH c AS (SELECT user_id, max(ord) AS o, max(k) AS k, max(bits) AS bits, count(*) AS n FROM ({_best_sql()}) GROUP BY 1)
        SELECT user_id, list_filter([CASE WHEN NOT o <= 0 THEN 'order' END, CASE WHEN NOT k <= 13 THEN 'parameter' END, CASE WHEN NOT bits <= 240 THEN 'bits' END, CASE WHEN NOT n >= 4 THEN 'frames' END], lambda x: x IS NOT NULL) AS reasons FROM c""",
)
def verdict_reasons(spark, sf):
    """A profile's refusals as names; an empty list is a pass."""
    c = best_fixed_rice(spark, sf).groupBy("user_id").agg(F.max("ord").alias("o"), F.max("k").alias("k"), F.max("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return c.select("user_id", S.reasons(order=F.col("o") <= 0, parameter=F.col("k") <= 13, bits=F.col("bits") <= 240, frames=F.col("n") >= 4).alias("reasons"))


@query("step_plan_legality", f"SELECT user_id, min(struct_pack(n := n, g := x % 200 - 4 * (n % 2))) AS first_bad FROM ({SIGNAL_SQL}) WHERE NOT (x % 200 - 4 * (n % 2) BETWEEN 0 AND 191) GROUP BY user_id")
def step_plan_legality(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    g = signal(spark, sf).select("user_id", (F.row_number().over(w) - 1).cast("long").alias("n"), "x").withColumn("g", F.expr("x % 200 - 4 * (n % 2)"))
    return g.where("not g between 0 and 191").groupBy("user_id").agg(F.min(F.struct("n", "g")).alias("first_bad"))


@query(
    "timeline_checks",
    """WITH t AS (SELECT o_custkey, o_orderkey AS f, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
       SELECT o_custkey, bool_and(before IS NULL OR before < f) AS ascending, count(*) = max(n) + 1 AS numbered, max(f - before) AS widest_gap FROM t GROUP BY o_custkey""",
)
def timeline_checks(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    t = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("f"), F.lag("o_orderkey").over(w).alias("before"), (F.row_number().over(w) - 1).alias("n"))
    return t.groupBy("o_custkey").agg(F.bool_and(F.col("before").isNull() | (F.col("before") < F.col("f"))).alias("ascending"), (F.count(F.lit(1)) == F.max("n") + 1).alias("numbered"), F.max(F.col("f") - F.col("before")).alias("widest_gap"))


@query("reciprocal_exact", "SELECT p_partkey, ((n - 1) * (137438953472 // n)) >> 32 = 31 AND 137438953472 // n > 0 AS exact FROM (SELECT p_partkey, 1000 + p_partkey * 1289 AS n FROM part)")
def reciprocal_exact(spark, sf):
    n = table(spark, sf, "part").select("p_partkey", F.expr("1000 + p_partkey * 1289").alias("n")).withColumn("r", B.bar_reciprocal("n"))
    return n.select("p_partkey", ((B.bar_cell(F.col("n") - 1, "r") == 31) & (F.col("r") > 0)).alias("exact"))


# code tables

_ROLES_SQL = "SELECT coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '^') AS prev, role AS symbol FROM conversations"


@query("context_bigrams", f"SELECT prev, symbol, count(*) AS n FROM ({_ROLES_SQL}) GROUP BY ALL")
def context_bigrams(spark, sf):
    return S.bigrams(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", "^")


def _event_bigrams(spark, sf):
    return S.bigrams(table(spark, sf, "events"), ["user_id"], "event_id", "event_type", "^")


@query(
    "huffman_lengths",
    """WITH RECURSIVE b AS (SELECT prev, symbol, count(*) AS n FROM (SELECT coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '^') AS prev, event_type AS symbol FROM events) GROUP BY ALL),
       i AS (SELECT prev, symbol, n, row_number() OVER (PARTITION BY prev ORDER BY symbol) - 1 AS i FROM b),
       h AS (SELECT prev, list(struct_pack(n := n, i := i, m := [i])) AS nodes, count(*) AS next, []::BIGINT[] AS hits FROM i GROUP BY prev
             UNION ALL SELECT prev, list_append(s[3:len(s)], struct_pack(n := s[1].n + s[2].n, i := next, m := list_concat(s[1].m, s[2].m))), next + 1, list_concat(hits, list_concat(s[1].m, s[2].m))
             FROM (SELECT *, list_sort(nodes) AS s FROM h) WHERE len(s) > 1)
       SELECT i.prev, i.symbol, greatest(len(list_filter(h.hits, lambda x: x = i.i)), CASE WHEN h.next = 1 THEN 1 ELSE 0 END)::BIGINT AS length FROM i JOIN h ON h.prev = i.prev AND len(h.nodes) = 1""",
)
def huffman_lengths(spark, sf):
    """A code per context; the merging is a recursion over a context's alphabet."""
    return S.train_codes(_event_bigrams(spark, sf), "prev", "symbol", "n")


@query("huffman_complete", "SELECT prev, true AS complete FROM (SELECT coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '^') AS prev FROM events) GROUP BY prev")
def huffman_complete(spark, sf):
    return S.kraft(S.train_codes(_event_bigrams(spark, sf), "prev", "symbol", "n"), ["prev"]).select("prev", "complete")


@query(
    "canonical_codes",
    """WITH l AS (SELECT p_brand AS ctx, p_size AS symbol, CASE WHEN p_size < 8 THEN 4 WHEN p_size < 20 THEN 6 ELSE 8 END AS length FROM part GROUP BY ALL)
       SELECT ctx, symbol, length, coalesce(sum(1 << (16 - length)) OVER (PARTITION BY ctx ORDER BY length, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> (16 - length) AS code FROM l""",
)
def canonical_codes(spark, sf):
    l = table(spark, sf, "part").select(F.col("p_brand").alias("ctx"), F.col("p_size").alias("symbol"), F.expr("case when p_size < 8 then 4 when p_size < 20 then 6 else 8 end").alias("length")).distinct()
    return S.canonical_codes(l, ["ctx"], "symbol")


@query("table_rebuild", f"SELECT x % 14 AS class, least(15, (x // 14) % 20) AS m, greatest(-7, least(7, round(16.0 * sum(x % 5) / count(*) - 32)))::BIGINT AS dq, count(*) AS n FROM ({SIGNAL_SQL}) GROUP BY ALL HAVING count(*) > 20")
def table_rebuild(spark, sf):
    s = signal(spark, sf).groupBy(F.expr("x % 14").alias("class"), F.expr("least(15, (x div 14) % 20)").alias("m")).agg(F.sum(F.expr("x % 5")).alias("s"), F.count(F.lit(1)).alias("n"))
    return s.where("n > 20").select("class", "m", F.greatest(F.lit(-7), F.least(F.lit(7), F.round(16.0 * F.col("s") / F.col("n") - 32))).cast("long").alias("dq"), "n")


# energy and ratios


@query("loudness_weights", "WITH t AS (SELECT event_type, 1 / (avg(value * value) + 1) AS w, count(*) AS n FROM events GROUP BY 1) SELECT event_type, round(w / (SELECT exp(sum(ln(w) * n) / sum(n)) FROM t), 9) AS weight FROM t")
def loudness_weights(spark, sf):
    return S.loudness_weights(table(spark, sf, "events").withColumn("energy", F.col("value") * F.col("value")), "event_type", "energy").select("event_type", F.round("weight", 9).alias("weight"))


_DIMS_SQL = "SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query("snr_by_group", f"WITH q AS (SELECT label, x, round(x * 16) / 16 AS y FROM ({_DIMS_SQL})) SELECT label, round(CASE WHEN sum(x * x) > 0 AND sum((x - y) * (x - y)) > 0 THEN 10 * log10(sum(x * x) / sum((x - y) * (x - y))) END, 6) AS snr FROM q GROUP BY label")
def snr_by_group(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return x.groupBy("label").agg(F.round(S.pooled_snr(F.col("x"), F.round(F.col("x") * 16) / 16), 6).alias("snr"))


@query("frame_energy", f"SELECT vec_id, round(sum(x * x), 6) AS energy, count(*) FILTER (abs(x) > 0.05) AS nonzero, max(i) FILTER (abs(x) > 0.05) AS last FROM ({_DIMS_SQL}) GROUP BY vec_id")
def frame_energy(spark, sf):
    e = F.col("embedding").cast("array<double>")
    loud = F.filter(F.transform(e, lambda x, i: F.when(F.abs(x) > 0.05, i.cast("long"))), lambda x: x.isNotNull())
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy"), F.size(loud).cast("long").alias("nonzero"), F.try_element_at(loud, F.lit(-1)).alias("last"))
