"""Recipes, logs and comparisons over text built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.registry import query
from strandline.session import table
from strandline.sources import textual

_RECIPE_SQL = "CASE p_partkey % 3 WHEN 0 THEN 'trim ' || p_size || '.5-end s' WHEN 1 THEN 'trim ' || p_size || '-' || (p_size + 9) || '.25 s, 2.5s fade-out' ELSE 'as it is' END"


@query(
    "recipe_fields",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size ELSE 0 END::DOUBLE AS trim_start, CASE WHEN p_partkey % 3 = 1 THEN p_size + 9.25 END::DOUBLE AS trim_end, CASE WHEN p_partkey % 3 = 1 THEN 2.5 ELSE 0 END::DOUBLE AS fade_out FROM part""",
)
def recipe_fields(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *textual.recipe(F.expr(_RECIPE_SQL)))


@query("encoder_report", "SELECT s_suppkey, (s_suppkey + 0.25)::DOUBLE AS kbit, CASE WHEN s_suppkey % 4 <> 0 THEN 20.5 END::DOUBLE AS snr, s_nationkey AS g_low, (s_nationkey + 60)::INT AS g_high, 0.001 * s_suppkey::DOUBLE AS lambda FROM supplier")
def encoder_report(spark, sf):
    text = F.expr("concat(s_suppkey, '.25 kbit/s', case when s_suppkey % 4 <> 0 then ' SNR 20.5' else '' end, '\\ng searched ', s_nationkey, '..', s_nationkey + 60, ' (lambda ', format_string('%.3f', 0.001D * s_suppkey), ')')")
    return table(spark, sf, "supplier").select("s_suppkey", *textual.encoder_log(text))


_RESULTS_SQL = "SELECT o_custkey * 1000 AS budget, count(*) * 600 AS bytes, max(o_totalprice) / 10000 AS snr FROM orders WHERE {} GROUP BY o_custkey"


@query(
    "encoder_comparison",
    f"""SELECT coalesce(a.budget, b.budget) AS budget, round(a.snr - b.snr, 6) AS gained_db, round(a.bytes / b.bytes, 6) AS bytes_ratio, coalesce(a.bytes <= a.budget AND b.bytes <= b.budget, false) AS both_fit
        FROM ({_RESULTS_SQL.format("o_orderstatus = 'O'")}) a FULL JOIN ({_RESULTS_SQL.format("o_orderstatus <> 'O'")}) b ON a.budget = b.budget""",
)
def encoder_comparison(spark, sf):
    o = table(spark, sf, "orders")
    one, two = (o.where(c).groupBy((F.col("o_custkey") * 1000).alias("budget")).agg((F.count(F.lit(1)) * 600).alias("bytes"), (F.max("o_totalprice") / 10000).alias("snr")) for c in ("o_orderstatus = 'O'", "o_orderstatus <> 'O'"))
    return textual.compare_encoders(one, two)
