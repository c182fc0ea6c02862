"""Event clusters: groups of articles with similar headlines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from wiregrid.functions import ids
from wiregrid.functions.text import WORD, word_set
from wiregrid.operators.keyed import join_weighted
from wiregrid.operators.leaders import assign_leaders
from wiregrid.operators.rank import rank_in_group
from wiregrid.operators.simjoin import SEPARATOR, Tuning, build_index
from wiregrid.session import materialize

DEFAULT_THRESHOLD = 0.4
#: Article ids per row of an exported id list.
CHUNK = 1 << 16


class Clustering(NamedTuple):
    clusters: DataFrame  # cluster_id, cluster_seq, ticker, representative_headline, article_count
    members: DataFrame  # cluster_id, member_pos, article_id


def leader_of_articles(
    articles: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    block_by: list[str] | None = None,
    tuning: Tuning = Tuning(),
) -> DataFrame:
    """Each article (`id`, `ticker`, `headline`, `seq`) with the `seq` of its leader.

    By default headlines are compared across all tickers; `block_by` names
    columns whose values must agree. `seq` gives the order of the feed; a
    decimal one gives way to the places 0, 1, 2 ... of the articles.
    """
    if isinstance(articles.schema["seq"].dataType, DecimalType):
        placed = rank_in_group(articles, [], [], "seq", "_place")
        articles, _ = materialize(placed.drop("seq").withColumnRenamed("_place", "seq"), "placed")
    feed = articles.select("id", "ticker", "headline", "seq", *[
        c for c in (block_by or []) if c not in ("id", "ticker", "headline", "seq")
    ])
    # JSON tells a null from an empty text and one column from the next.
    block = F.to_json(F.struct(*block_by)) if block_by else F.lit("")
    if threshold <= 0:
        # Every similarity is high enough: the first article leads all. Without
        # blocks that is a single row.
        first = feed.groupBy(block.alias("_block")).agg(F.min("seq").alias("leader_seq"))
        return (
            feed.withColumn("_block", block)
            .join(first if block_by else F.broadcast(first), "_block")
            .select("id", "ticker", "headline", "seq", "leader_seq")
        )
    if threshold > 1:
        return feed.select("id", "ticker", "headline", "seq", F.col("seq").alias("leader_seq"))
    index = build_index(feed, threshold, block, tuning)
    led = assign_leaders(index)
    per_set = index.sets.join(led, "seq", "left").select(
        F.concat_ws(SEPARATOR, "block", "set_key").alias("_set"),
        F.coalesce("leader", "seq").alias("leader_seq"),
        "copies",
    )
    words = F.array_join(F.array_sort(word_set(F.col("headline"))), SEPARATOR)
    # A headline without words resembles nothing, not even its copies.
    keyed = feed.select(
        "id", "ticker", "headline", "seq",
        F.when(F.col("headline").rlike(WORD), F.concat_ws(SEPARATOR, block, words))
        .otherwise(F.concat(F.lit(f"{SEPARATOR}{SEPARATOR}"), F.col("seq")))
        .alias("_set"),
    )
    joined = join_weighted(
        keyed, per_set, "_set", "copies", index.articles, how="left", heavy_rows_min=tuning.heavy_rows_min
    )
    return joined.select(
        "id", "ticker", "headline", "seq", F.coalesce("leader_seq", "seq").alias("leader_seq")
    )


def cluster_articles(
    articles: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    block_by: list[str] | None = None,
    tuning: Tuning = Tuning(),
) -> Clustering:
    """Group articles around leaders; ids are unique and every article lands in one cluster."""
    assigned, seen = materialize(
        leader_of_articles(articles, threshold, block_by, tuning), "assigned"
    )
    leads = F.col("seq") == F.col("leader_seq")
    first = F.max(F.when(leads, F.struct("id", "ticker", "headline")))
    clusters = (
        assigned.groupBy("leader_seq")
        .agg(first.alias("_first"), F.count(F.lit(1)).alias("article_count"))
        .select(
            ids.cluster_id(F.col("_first.id"), F.col("article_count"), F.col("_first.ticker")).alias(
                "cluster_id"
            ),
            F.col("leader_seq").alias("cluster_seq"),
            F.col("_first.ticker").alias("ticker"),
            F.col("_first.headline").alias("representative_headline"),
            "article_count",
        )
    )
    clusters, _ = materialize(clusters, "clusters")
    ranked = rank_in_group(
        assigned.select("leader_seq", "seq", F.col("id").alias("article_id")),
        ["leader_seq"], [], "seq", "member_pos",
    )
    named = join_weighted(
        ranked,
        clusters.select(F.col("cluster_seq").alias("leader_seq"), "cluster_id", "article_count"),
        "leader_seq",
        "article_count",
        seen["rows"],
        heavy_rows_min=tuning.heavy_rows_min,
    )
    return Clustering(clusters, named.select("cluster_id", "member_pos", "article_id"))


def member_chunks(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ordered id lists, one row per `chunk` members; most clusters have a single row."""
    grouped = members.groupBy(
        "cluster_id", F.floor(F.col("member_pos") / chunk).alias("chunk")
    ).agg(F.array_sort(F.collect_list(F.struct("member_pos", "article_id"))).alias("_ids"))
    return grouped.select(
        "cluster_id", "chunk", F.transform("_ids", lambda pair: pair["article_id"]).alias("article_ids")
    )


def members_from_json(clusters: DataFrame, ids_column: str = "article_ids") -> DataFrame:
    """Members of clusters whose ids arrive as a JSON array; none for a null."""
    listed = F.from_json(F.coalesce(F.col(ids_column), F.lit("[]")), "array<string>")
    return clusters.select("cluster_id", F.posexplode(listed).alias("_pos", "article_id")).select(
        "cluster_id", F.col("_pos").cast("long").alias("member_pos"), "article_id"
    )
