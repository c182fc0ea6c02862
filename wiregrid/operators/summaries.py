"""Extractive cluster summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrid.functions.text import strip, truncate

SUMMARY_LIMIT = 400
SENTENCE_LIMIT = 150


def summarize(clusters: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """`clusters` with `summary`: headline, longest other text, number of sources.

    Texts travel as their digest, their length and their first characters
    only, and are reduced per (cluster, digest) before any cluster is looked
    at as a whole.
    """
    headline = F.coalesce("representative_headline", F.lit(""))
    opening = truncate(headline, SENTENCE_LIMIT)
    # The opening sentence takes part as a text that is already used.
    used = clusters.select(
        "cluster_id",
        F.sha2(F.lower(opening), 256).alias("digest"),
        F.lit(True).alias("used"),
        F.lit(0).cast("long").alias("found"),
        F.lit(None).cast("struct<pos:bigint,place:int,size:int,shown:string>").alias("text"),
    )
    texts = articles.select(
        F.col("id").alias("article_id"),
        F.posexplode(
            F.array(
                strip(F.coalesce("summary", F.lit(""))), strip(F.coalesce("headline", F.lit("")))
            )
        ).alias("place", "_text"),
    ).select(
        "article_id",
        "place",
        F.sha2(F.lower("_text"), 256).alias("digest"),
        F.length("_text").alias("size"),
        truncate(F.col("_text"), SENTENCE_LIMIT).alias("shown"),
    )
    candidates = members.join(texts, "article_id").select(
        "cluster_id",
        "digest",
        F.lit(False).alias("used"),
        (F.col("place") == 0).cast("long").alias("found"),
        F.when(
            F.col("size") > 0,
            F.struct(F.col("member_pos").alias("pos"), "place", "size", "shown"),
        ).alias("text"),
    )
    first_seen = (
        candidates.unionByName(used)
        .groupBy("cluster_id", "digest")
        .agg(F.max("used").alias("used"), F.sum("found").alias("found"), F.min("text").alias("text"))
    )
    fresh = F.when(
        ~F.col("used"),
        F.struct(
            F.col("text.size").alias("size"),
            (-F.col("text.pos")).alias("pos"),
            (-F.col("text.place")).alias("place"),
            F.col("text.shown").alias("shown"),
        ),
    )
    chosen = first_seen.groupBy("cluster_id").agg(
        F.sum("found").alias("_found"),
        F.max(F.when(F.col("text").isNotNull(), fresh)).alias("_best"),
    )
    found = F.coalesce("_found", F.lit(0))
    parts = F.array_compact(
        F.array(
            opening,
            F.col("_best.shown"),
            F.when(found > 1, F.concat(F.lit("("), found.cast("string"), F.lit(" sources)"))),
        )
    )
    summary = F.when(found == 0, truncate(headline, SUMMARY_LIMIT)).otherwise(
        truncate(F.array_join(parts, " "), SUMMARY_LIMIT)
    )
    kept = [c for c in clusters.columns if c != "summary"]
    return clusters.join(chosen, "cluster_id", "left").select(*kept, summary.alias("summary"))
