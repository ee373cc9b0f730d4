"""Producer against consumer: what a running query's progress says about every period.

A stream with a processing-time trigger is an interrupt that takes what is there each period. Its
progress events are the measurement: rows taken, time spent, and if a period was missed or empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "batch long, rows long, spent_ms long, state_rows long"


def measured(spark: SparkSession, progress: Iterable) -> DataFrame:
    """batch, rows, spent_ms, state_rows of a query's recentProgress; its length is bounded by Spark."""
    rows = []
    for p in progress:
        p = p if isinstance(p, dict) else json.loads(p.json)
        rows.append((p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0), sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", []))))
    return spark.createDataFrame(rows, SCHEMA)


def report(periods: DataFrame, period_ms: int, wanted_rows: int = 1) -> DataFrame:
    """One row: periods, served, starved (fewer than wanted_rows), late (longer than a period), worst_ms, most_rows."""
    return periods.agg(
        F.count(F.lit(1)).alias("periods"), F.count_if(F.col("rows") >= wanted_rows).alias("served"), F.count_if(F.col("rows") < wanted_rows).alias("starved"),
        F.count_if(F.col("spent_ms") > period_ms).alias("late"), F.max("spent_ms").alias("worst_ms"), F.max("rows").alias("most_rows"),
    )
