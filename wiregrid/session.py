"""Session settings and the materialisation point used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "wiregrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; `conf` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir.

    A machine-local folder is only ever used in local mode.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="wiregrid-")
    return _LOCAL_DIRS[app]


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables, under one folder per application."""
    folder = f"{shared_dir(spark)}/wiregrid-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(folder)
    return folder


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The folders that `scratch_dir` names meanwhile, to be dropped once nothing reads them."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        # By identity: scopes that hold the same folders are equal.
        _SCOPES[:] = [scope for scope in _SCOPES if scope is not made]


def drop_scratch(spark: SparkSession, folders: Iterable[str]) -> None:
    """Remove folders that `scratch_dir` named."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame, *columns) -> DataFrame:
    """`df` with `columns` added in a way that later filters do not repeat their work.

    The optimiser moves a filter below the projections it reads and copies
    their expressions into it; it does not move one below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def materialize(df: DataFrame, label: str, *metrics, partition_by: list[str] | None = None):
    """Write `df` as a table in the shared folder and read it back.

    Returns the stored table and a dict of metrics observed on the way, which
    always holds `rows`. The stored table survives the loss of any executor,
    its lineage is one scan, and its true size is known to the planner, so
    small tables are broadcast by Spark's own size check.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}"
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics)
    writer = watched.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get
