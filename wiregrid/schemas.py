"""Table layouts."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _table(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _I, _D, _B, _T = (
    StringType(), LongType(), IntegerType(), DoubleType(), BooleanType(), TimestampType(),
)

#: Type of `seq` as `feed_order` makes it.
FEED_ORDER = DecimalType(28, 0)

RAW_ARTICLE = _table(
    ("ticker", _S, True),
    ("fetch_date", DateType(), True),
    ("batch_pos", _I, True),
    ("raw_json", _S, True),
)

WATCHLIST = _table(("ticker", _S, False), ("position", _I, False))

ARTICLES = _table(
    ("id", _S, False),
    ("ticker", _S, False),
    ("headline", _S, False),
    ("summary", _S, True),
    ("source", _S, True),
    ("url", _S, True),
    ("published_at", _T, True),
    ("fetched_at", _T, True),
    ("raw_json", _S, True),
    ("seq", FEED_ORDER, False),
)

REJECTS = _table(
    ("ticker", _S, True),
    ("batch_pos", _I, True),
    ("raw_json", _S, True),
    ("reason", _S, False),
)

SCORES = _table(
    ("article_id", _S, False),
    ("is_relevant", _B, True),
    ("relevance_score", _D, True),
    ("importance_score", _I, True),
    ("event_type", _S, True),
    ("confidence", _S, True),
    ("include_in_digest", _B, True),
    ("reason", _S, True),
    ("scored_at", _T, True),
)

CLUSTERS = _table(
    ("cluster_id", _S, False),
    ("cluster_seq", _L, False),
    ("ticker", _S, True),
    ("representative_headline", _S, True),
    ("summary", _S, True),
    ("article_count", _L, True),
    ("created_at", _T, True),
)

MEMBERS = _table(
    ("cluster_id", _S, False),
    ("member_pos", _L, False),
    ("article_id", _S, False),
)

MEMBER_CHUNKS = _table(
    ("cluster_id", _S, False),
    ("chunk", _L, False),
    ("article_ids", ArrayType(_S), False),
)

DIGEST_RUNS = _table(
    ("id", _S, False),
    ("version", _L, False),
    ("run_date", DateType(), True),
    ("subject", _S, True),
    ("sent_at", _T, True),
    ("recipient", _S, True),
    ("status", _S, True),
)

DIGEST_TEXTS = _table(
    ("id", _S, False),
    ("version", _L, False),
    ("text_part", _L, False),
    ("text_content", _S, True),
)

RUN_LOGS = _table(
    ("run_id", _S, True),
    ("step_order", _I, True),
    ("step", _S, True),
    ("status", _S, True),
    ("duration_ms", _L, True),
    ("message", _S, True),
    ("logged_at", _T, True),
)

ARTICLE_REJECTS = _table(
    ("ticker", _S, True), ("batch_pos", _I, True), ("raw_json", _S, True), ("reason", _S, True)
)
SCORE_REJECTS = _table(("article_id", _S, True), ("reason", _S, True))

TABLES: dict[str, StructType] = {
    "watchlist": WATCHLIST,
    "articles": ARTICLES,
    "article_scores": SCORES,
    "event_clusters": CLUSTERS,
    "cluster_members": MEMBERS,
    "digest_runs": DIGEST_RUNS,
    "digest_texts": DIGEST_TEXTS,
    "run_logs": RUN_LOGS,
    "article_rejects": ARTICLE_REJECTS,
    "score_rejects": SCORE_REJECTS,
}

#: Columns that identify a row of each table.
KEYS: dict[str, list[str]] = {
    "watchlist": ["ticker"],
    "articles": ["id"],
    "article_scores": ["article_id"],
    "event_clusters": ["cluster_id"],
    "cluster_members": ["cluster_id", "member_pos"],
    "digest_runs": ["id", "version"],
    "digest_texts": ["id", "version", "text_part"],
}
