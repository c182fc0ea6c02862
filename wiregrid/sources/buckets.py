"""Keyed tables whose snapshots share what did not change.

A table is cut into buckets by a hash of its keys. A batch of rows rewrites the
buckets its keys fall into, under its version, and nothing else; a manifest, a
row per bucket, tells which version of each bucket a snapshot consists of. The
manifest is written last and makes the snapshot: a write that was lost half way
is never read, and writing a version again replaces it. Older snapshots stay
readable.

Defined results: of rows with one key in a batch the first by `newest_first`
counts, and it replaces the stored one. Null keys are keys like any other. A
batch without rows makes a snapshot equal to the one before. The number of
buckets is fixed by the first batch.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wiregrid.operators import keyed
from wiregrid.session import materialize
from wiregrid.sources.tables import _read

_MANIFEST = "snapshot long, bucket int, version long, buckets int"


def _manifest(spark: SparkSession, root: str, table: str, snapshot: int | None) -> tuple[dict[int, int], int]:
    """({bucket: version}, buckets) of the newest snapshot not after `snapshot`; a row per bucket."""
    rows = _read(spark, f"{root}/_manifests/{table}", _MANIFEST)
    if snapshot is not None:
        rows = rows.where(F.col("snapshot") <= snapshot)
    newest = rows.agg(F.max("snapshot")).first()[0]
    live = rows.where(F.col("snapshot") == F.lit(newest)).collect()
    return {r["bucket"]: r["version"] for r in live if r["bucket"] >= 0}, max(
        [r["buckets"] for r in live], default=0
    )


def _parts(
    spark: SparkSession, root: str, table: str, live: dict[int, int], schema: StructType
) -> DataFrame:
    paths = [f"{root}/{table}/version={v}/bucket={b}" for b, v in sorted(live.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(
    spark: SparkSession, root: str, table: str, schema: StructType, snapshot: int | None = None
) -> DataFrame:
    """The newest snapshot of a table, or the newest not after `snapshot`; empty if there is none."""
    live, _ = _manifest(spark, root, table, snapshot)
    return _parts(spark, root, table, live, schema)


def merge(
    rows: DataFrame, root: str, table: str, version: int, keys: list[str], newest_first: list,
    buckets: int = 64,
) -> list[int]:
    """Make snapshot `version`, in which `rows` replaced those of equal key; the buckets rewritten."""
    spark, schema = rows.sparkSession, rows.schema
    live, fixed = _manifest(spark, root, table, version - 1)
    buckets = fixed or buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    batch, _ = materialize(rows, f"{table}-batch")
    # At most as many as there are buckets.
    touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())
    stored = _parts(spark, root, table, {b: v for b, v in live.items() if b in set(touched)}, schema)
    newest = keyed.first_per_key(batch, keys, newest_first)
    named = newest.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    merged = stored.join(named, same, "left_anti").unionByName(newest)
    if touched:
        # Rows of a bucket go to few tasks, so that it has few files.
        (
            merged.withColumn("bucket", bucket)
            .hint("rebalance", "bucket")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{root}/{table}/version={version}")
        )
    told = {**live, **dict.fromkeys(touched, version)} or {-1: version}
    manifest = spark.createDataFrame(
        [(version, b, v, buckets) for b, v in told.items()], _MANIFEST
    ).drop("snapshot")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifests/{table}/snapshot={version}")
    return touched
