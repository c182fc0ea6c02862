"""Ranks within groups of any size, without one task ever sorting a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from wiregrid.session import materialize

#: Width of a block of sequence numbers; a block holds at most this many rows.
BLOCK_BITS = 16


def rank_in_group(
    df: DataFrame, keys: list[str], lead: list[Column], seq: str, name: str, start: int = 0
) -> DataFrame:
    """Number the rows of each group by `lead`, then by the unique `seq`, a long or whole decimal.

    A group is cut into blocks of equal `lead` and neighbouring `seq`. Rows
    are numbered inside their block, and each block starts where the ones
    before it end. Only block counts are summed per group, never rows.
    """
    if isinstance(df.schema[seq].dataType, DecimalType):
        block = F.floor(F.col(seq) / F.lit(1 << BLOCK_BITS))
    else:
        block = F.shiftright(F.col(seq), BLOCK_BITS)
    lead_names = [f"_lead{i}" for i in range(len(lead))]
    blocked = df.select(
        "*",
        *[column.alias(lead_name) for column, lead_name in zip(lead, lead_names)],
        block.alias("_block"),
    )
    place = [*lead_names, "_block"]
    before = (
        Window.partitionBy(*keys)
        .orderBy(*place)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        blocked.groupBy(*keys, *place)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, *place).orderBy(seq))
    return (
        blocked.withColumn("_inside", inside)
        .join(starts, [*keys, *place])
        .withColumn(name, (F.col("_start") + F.col("_inside") - 1 + start).cast("long"))
        .drop(*place, "_inside", "_start")
    )


def in_order(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """`df` with dense places 0, 1, 2 ... in `order`, which no two rows share, as `name`.

    The table is cut into ranges that follow one another, each sorted by itself. Only the number of
    rows of each range is added up, a row per range; no task ever sorts or numbers the whole.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    stored, _ = materialize(ranged, "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    # As many rows as there are ranges.
    return (
        stored.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_range")
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_range", "_inside", "_start")
    )
