"""Incremental ingest of landed raw batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wiregrid.operators.normalize import normalize
from wiregrid.schemas import RAW_ARTICLE
from wiregrid.sources.landing import in_feed_order
from wiregrid.sources.tables import append, append_new


def landed_stream(spark: SparkSession, landing: str, **options: str) -> DataFrame:
    """Raw records as they land."""
    reader = spark.readStream.schema(RAW_ARTICLE)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(landing).where(F.col("batch_pos") >= 0)


def ingest_new(
    spark: SparkSession,
    landing: str,
    watchlist: DataFrame,
    store: str,
    checkpoint: str,
    **options: str,
) -> StreamingQuery:
    """Take up all files landed since the last call: first record of an id wins, ever.

    Each micro-batch is one batch of the stored table and replaces itself when
    it is run again after a failure.
    """

    def take_up(batch: DataFrame, batch_id: int) -> None:
        articles, rejects = normalize(in_feed_order(batch, watchlist))
        append_new(articles, store, "articles", batch_id, "seq", within="published_at")
        append(rejects, store, "article_rejects", batch_id)

    return (
        landed_stream(spark, landing, **options)
        .writeStream.foreachBatch(take_up)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def recent_only(
    articles: DataFrame, horizon: str = "24 hours", arrived: str | None = None
) -> DataFrame:
    """A stream of articles without those re-sent within the horizon of their arrival.

    `arrived` names the column with the time a record arrived; without it, that is the time it is
    read. Arrival never lies before that of earlier batches, so an old article that comes for the
    first time is kept. State is bounded by the horizon: an article re-sent later passes again; use
    `ingest_new` where the first record must win for good.
    """
    timed = articles.withColumn(
        "_arrived", F.col(arrived) if arrived else F.current_timestamp()
    ).withWatermark("_arrived", horizon)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("_arrived")
