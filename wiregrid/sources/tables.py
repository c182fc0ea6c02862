"""Stored tables as Parquet: append-only ones and ones kept as snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wiregrid.operators import keyed
from wiregrid.schemas import KEYS, TABLES
from wiregrid.session import materialize

_BATCH = "batch_id"
_SNAPSHOT = "snapshot"
_COMMITS = "commits"
_COMMIT = StructType([StructField(_SNAPSHOT, LongType())])


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _with(schema: StructType, column: str) -> StructType:
    return StructType([*schema.fields, StructField(column, LongType())])


def read_appended(
    spark: SparkSession, root: str, table: str, before_batch: int | None = None
) -> DataFrame:
    """An append-only table; empty if it was never written."""
    stored = _read(spark, f"{root}/{table}", _with(TABLES[table], _BATCH))
    if before_batch is not None:
        stored = stored.where(F.col(_BATCH) < before_batch)
    return stored.drop(_BATCH)


def append(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Append rows as one batch; writing a batch again replaces it."""
    fitted = rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )
    fitted.write.mode("overwrite").parquet(f"{root}/{table}/{_BATCH}={batch_id}")


def append_new(
    rows: DataFrame, root: str, table: str, batch_id: int, order: str, within: str | None = None,
    seen: Observation | None = None,
) -> None:
    """Append the rows whose key is not stored yet; within the batch the first by `order` wins.

    `within` names a column that the key determines, such as the time an
    article was published: stored rows outside its range in the batch cannot
    have an equal key, and Parquet statistics skip them.
    """
    spark = rows.sparkSession
    stored = read_appended(spark, root, table, before_batch=batch_id)
    if within is not None:
        rows, edges = materialize(
            rows, f"{table}-batch", F.min(within).alias("low"), F.max(within).alias("high")
        )
        stored = stored.where(F.col(within).between(F.lit(edges["low"]), F.lit(edges["high"])))
    fresh = keyed.insert_or_ignore(rows, stored, KEYS[table], [F.col(order)])
    if seen is not None:
        fresh = fresh.observe(seen, F.count(F.lit(1)).alias("rows"))
    append(fresh, root, table, batch_id)


def read_snapshot(
    spark: SparkSession, root: str, table: str, snapshot: int | None = None, exact: bool = False
) -> DataFrame:
    """The newest committed snapshot of a table, or the newest not after `snapshot`.

    With `exact` it is that snapshot or, if it was never committed, no rows. A snapshot without
    rows counts like any other.
    """
    stored = _read(spark, f"{root}/{table}", _with(TABLES[table], _SNAPSHOT))
    commits = _read(spark, f"{root}/{_COMMITS}/{table}", _COMMIT)
    if snapshot is not None:
        known = F.col(_SNAPSHOT) == snapshot if exact else F.col(_SNAPSHOT) <= snapshot
        commits = commits.where(known)
    newest = commits.agg(F.max(_SNAPSHOT)).first()[0]
    return stored.where(F.col(_SNAPSHOT) == F.lit(newest)).drop(_SNAPSHOT)


def read_snapshots(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All snapshots of a table, told apart by their number in `snapshot`."""
    return _read(spark, f"{root}/{table}", _with(TABLES[table], _SNAPSHOT))


def write_snapshot(rows: DataFrame, root: str, table: str, snapshot: int) -> None:
    """Store the whole table as a new snapshot; older ones stay readable."""
    fitted = rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ]
    )
    fitted.write.mode("overwrite").parquet(f"{root}/{table}/{_SNAPSHOT}={snapshot}")
    # A small row per snapshot tells that it is whole, also where it has no rows.
    commit = rows.sparkSession.range(1).select(F.lit(snapshot).cast("long").alias(_SNAPSHOT))
    commit.write.mode("overwrite").parquet(f"{root}/{_COMMITS}/{table}/of={snapshot}")


def replace_rows(rows: DataFrame, root: str, table: str, snapshot: int, newest_first: list) -> None:
    """New snapshot in which `rows` replaced those of equal key."""
    stored = read_snapshot(rows.sparkSession, root, table, snapshot - 1)
    write_snapshot(
        keyed.insert_or_replace(rows.select(*stored.columns), stored, KEYS[table], newest_first),
        root, table, snapshot,
    )
