"""Run log rows and the counters of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(run_log: DataFrame) -> DataFrame:
    """Per run: steps, errors, time and the overall status.

    A run failed if its fetch or compose step did, and is partial if any
    other step had an error.
    """
    bad = F.col("status") == "error"
    fatal = bad & F.col("step").isin("fetch", "compose")
    per_step = run_log.groupBy("run_id", "step").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("bad"),
        F.count_if(fatal).alias("fatal"),
        F.sum("duration_ms").alias("busy_ms"),
        F.min("logged_at").alias("first_at"),
        F.max("logged_at").alias("last_at"),
    )
    status = (
        F.when(F.sum("fatal") > 0, F.lit("failed"))
        .when(F.sum("bad") > 0, F.lit("partial"))
        .otherwise(F.lit("success"))
    )
    return per_step.groupBy("run_id").agg(
        status.alias("status"),
        F.count(F.lit(1)).alias("steps"),
        F.sum("rows").alias("entries"),
        F.sum("bad").alias("errors"),
        F.sum("busy_ms").alias("busy_ms"),
        F.timestamp_diff("MILLISECOND", F.min("first_at"), F.max("last_at")).alias("span_ms"),
    )


def counters(counted: dict[str, DataFrame]) -> DataFrame:
    """(counter, value): the rows of each table, 0 where there are none."""
    rows = None
    for name, df in counted.items():
        one = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("counter"), "value")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def distinct_steps(run_log: DataFrame) -> DataFrame:
    return run_log.select("run_id", "step").distinct()
