"""Table constraints as a report of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    doubled = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    return _row(doubled.agg(F.count(F.lit(1)).alias("violations")), table, "primary key")


def missing_values(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One row per column that must not be null, all counted in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    found = [
        F.struct(F.lit(f"not null {c}").alias("rule"), F.col(c).alias("violations"))
        for c in columns
    ]
    named = F.explode(F.array(*found))
    return counted.select(named.alias("_n")).select(
        F.lit(table).alias("table_name"),
        "_n.rule",
        F.col("_n.violations").cast("long").alias("violations"),
    )


def orphans(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent; values are reduced before the join."""
    used = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    lost = used.join(parent.select(F.col(parent_key).alias("_ref")), "_ref", "left_anti")
    return _row(
        lost.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("violations")),
        table,
        f"foreign key {column}",
    )


def _row(counted: DataFrame, table: str, rule: str) -> DataFrame:
    return counted.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.col("violations").cast("long").alias("violations"),
    )


def constraint_report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
