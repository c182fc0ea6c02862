"""Joins and merges by key that stay balanced when one key is very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most this many heavy keys exist, because each holds more than 1/LIMIT of all rows.
HEAVY_KEYS_LIMIT = 10_000
#: Fewer rows than this per key are no burden to a task.
HEAVY_ROWS_MIN = 50_000


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.

    Spark turns the rank filter into a group limit that runs before the
    shuffle, so each task sends at most one row per key, however hot.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def insert_or_ignore(
    batch: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]
) -> DataFrame:
    """The rows of `batch` to append to `stored` when the first row of a key wins."""
    return first_per_key(batch, keys, order).join(stored.select(*keys), keys, "left_anti")


def insert_or_replace(
    batch: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]
) -> DataFrame:
    """The whole table after `batch` replaced rows of `stored`; pass `order` newest first."""
    newest = first_per_key(batch, keys, order)
    kept = stored.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest)


def update_by_key(
    stored: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]
) -> DataFrame:
    """`stored` with `columns` overwritten where `updates` has the key.

    Of several updates of one key the one with the greatest values counts, so no row is multiplied.
    """
    one = updates.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_new"))
    renamed = one.select(
        *keys, F.lit(True).alias("_hit"), *[F.col("_new")[c].alias(f"_new_{c}") for c in columns]
    )
    joined = stored.join(renamed, keys, "left")
    values = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns
        else F.col(c)
        for c in stored.columns
    ]
    return joined.select(*values)


def insert_counts(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows of `batch` would be inserted and how many skipped."""
    per_key = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    fresh = F.col("_known").isNull()
    return per_key.join(known, keys, "left").agg(
        F.coalesce(F.sum(F.when(fresh, 1).otherwise(0)), F.lit(0)).cast("long").alias("inserted"),
        F.coalesce(F.sum(F.col("_rows") - F.when(fresh, 1).otherwise(0)), F.lit(0))
        .cast("long")
        .alias("skipped"),
    )


def join_weighted(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    total_rows: int,
    how: str = "inner",
    heavy_rows_min: int = HEAVY_ROWS_MIN,
    heavy_keys_limit: int = HEAVY_KEYS_LIMIT,
) -> DataFrame:
    """Join (inner or left) of many `left` rows to `right`, unique by `key`, balanced under skew.

    `weight` is the number of `left` rows of each key, and `total_rows` their
    sum. Keys heavier than total_rows / heavy_keys_limit number fewer than
    heavy_keys_limit by counting, so they are broadcast; the `left` rows they
    match take a key of their own in the shuffle that serves the others.
    """
    floor = max(heavy_rows_min, total_rows // heavy_keys_limit)
    if total_rows <= floor:
        return left.join(right.drop(weight), key, how)
    values = [c for c in right.columns if c not in (key, weight)]
    packed = F.struct(*[F.col(c) for c in values])
    heavy = right.where(F.col(weight) > floor).select(key, packed.alias("_heavy"))
    light = right.where(F.col(weight) <= floor).select(
        F.col(key).cast("string").alias("_route"), packed.alias("_light")
    )
    # A heavy row needs no partner in the second join: any spread-out key will do.
    route = F.when(F.col("_heavy").isNull(), F.col(key).cast("string")).otherwise(
        F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in left.columns]).cast("string"))
    )
    joined = (
        left.join(F.broadcast(heavy), key, "left")
        .withColumn("_route", route)
        .join(light, "_route", "left")
    )
    found = F.coalesce(F.col("_heavy"), F.col("_light"))
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(
        *left.columns, *[found[c].alias(c) for c in values]
    )
