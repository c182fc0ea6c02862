"""Scoring: the lexicon rules, or any scorer with the same output."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrid.functions import scoring
from wiregrid.functions.lexicon import (
    CONFIDENCE_LEVELS,
    DEFAULT_LEXICON,
    EVENT_TYPES,
    PLAN_KEYWORDS,
    Lexicon,
    keyword_count,
)
from wiregrid.operators.lexicon_match import lexicon_table, table_hits
from wiregrid.session import settle

#: A scorer takes articles and returns SCORES rows (`scored_at` aside).
Scorer = Callable[[DataFrame], DataFrame]

SCORE_COLUMNS = [
    "article_id", "is_relevant", "relevance_score", "importance_score",
    "event_type", "confidence", "include_in_digest", "reason",
]


class Scored(NamedTuple):
    scores: DataFrame
    rejects: DataFrame  # article_id, reason


def lexicon_hits(
    articles: DataFrame, lexicon: Lexicon | DataFrame = DEFAULT_LEXICON
) -> DataFrame:
    """Articles with `hits` (array in lexicon order), `total_high`, `total_medium` and `best`.

    A lexicon given as a table, or too large for a plan, is matched by an index.
    """
    if isinstance(lexicon, DataFrame):
        return table_hits(articles, lexicon)
    if keyword_count(lexicon) > PLAN_KEYWORDS:
        return table_hits(articles, lexicon_table(articles, lexicon))
    text = scoring.score_text(F.col("headline"), F.col("summary"))
    counted = articles.withColumn("_text", text).withColumn(
        "hits", scoring.hits_by_type(F.col("_text"), lexicon)
    )
    hits = F.col("hits")
    return settle(
        counted.drop("_text"),
        scoring.total(hits, "high").alias("total_high"),
        scoring.total(hits, "medium").alias("total_medium"),
        scoring.best_hit(hits).alias("best"),
    )


def score_articles(
    articles: DataFrame,
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON,
    relevance_threshold: float = scoring.RELEVANCE_THRESHOLD,
    importance_threshold: int = scoring.IMPORTANCE_THRESHOLD,
) -> DataFrame:
    """One score per article; in one pass and without a shuffle if the lexicon is part of the plan."""
    hits = lexicon_hits(articles.select("id", "headline", "summary"), lexicon)
    best = F.col("best")
    rated = hits.select(
        "id",
        "best",
        scoring.relevance(F.col("total_high"), F.col("total_medium")).alias("_relevance"),
        scoring.importance(best).alias("importance_score"),
        scoring.event_type(best).alias("event_type"),
        scoring.confidence(best).alias("confidence"),
    )
    relevant = F.col("_relevance") >= F.lit(relevance_threshold)
    included = relevant & (F.col("importance_score") >= importance_threshold)
    return rated.select(
        F.col("id").alias("article_id"),
        relevant.alias("is_relevant"),
        F.round("_relevance", 4).alias("relevance_score"),
        "importance_score",
        "event_type",
        "confidence",
        included.alias("include_in_digest"),
        scoring.reason(relevant, included, F.col("event_type"), best).alias("reason"),
    )


def _fault() -> Column:
    """What is wrong with a score row; null if nothing is."""
    return (
        F.when(F.col("article_id").isNull(), F.lit("no article"))
        .when(~F.coalesce(F.col("relevance_score").between(0, 1), F.lit(False)), F.lit("relevance"))
        .when(~F.coalesce(F.col("importance_score").between(0, 100), F.lit(False)), F.lit("importance"))
        .when(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), F.lit("event type"))
        .when(~F.coalesce(F.col("confidence").isin(*CONFIDENCE_LEVELS), F.lit(False)), F.lit("confidence"))
    )


def run_scorer(articles: DataFrame, scorer: Scorer | None = None) -> Scored:
    """Apply a scorer (the lexicon rules by default); rows that break the contract are rejects.

    A scorer may add an `error` column: rows where it is set are rejects too.
    """
    if scorer is None:
        scores = score_articles(articles)
        return Scored(scores, scores.select("article_id", "reason").limit(0))
    scored = scorer(articles)
    missing = [c for c in SCORE_COLUMNS if c not in scored.columns]
    if missing:
        raise ValueError(f"the scorer returned no {', '.join(missing)}")
    fault = _fault()
    if "error" in scored.columns:
        fault = F.coalesce("error", fault)
    checked = settle(scored, fault.alias("_fault"))
    return Scored(
        checked.where(F.col("_fault").isNull()).select(*SCORE_COLUMNS),
        checked.where(F.col("_fault").isNotNull()).select(
            "article_id", F.col("_fault").alias("reason")
        ),
    )


def _typed(name: str, value: object) -> object:
    """The value as the column `name` holds it; an error if it is of another kind."""
    if value is None:
        return None
    kinds, made = {
        "is_relevant": ((bool, np.bool_), bool),
        "include_in_digest": ((bool, np.bool_), bool),
        "relevance_score": ((int, float, np.integer, np.floating), float),
        "importance_score": ((int, np.integer), int),
    }.get(name, ((str,), str))
    if not isinstance(value, kinds) or (made in (int, float) and isinstance(value, bool)):
        raise TypeError(f"{name} is {type(value).__name__}")
    plain = made(value)
    if made is int and not -(2**31) <= plain < 2**31:
        raise OverflowError(f"{name} does not fit")
    return plain


_PYTHON_SCORE = (
    "article_id string, is_relevant boolean, relevance_score double, importance_score int, "
    "event_type string, confidence string, include_in_digest boolean, reason string, error string"
)


def python_scorer(score_one: Callable[[dict], dict], columns: list[str] | None = None) -> Scorer:
    """A scorer from a Python function of one article; a failing article does not stop the rest."""
    fields = SCORE_COLUMNS[1:]

    def scorer(articles: DataFrame) -> DataFrame:
        def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for article in batch.to_dict("records"):
                    row = dict.fromkeys(["article_id", *fields, "error"])
                    row["article_id"] = article["id"]
                    try:
                        result = score_one(article)
                        row.update({name: _typed(name, result[name]) for name in fields})
                    except Exception as exc:  # the contract: record it and go on
                        row["error"] = f"{type(exc).__name__}: {exc}"
                    rows.append(row)
                yield pd.DataFrame(rows, columns=["article_id", *fields, "error"])

        wanted = ["id", *[c for c in (columns or ["headline", "summary"]) if c != "id"]]
        return articles.select(*wanted).mapInPandas(score_batches, _PYTHON_SCORE)

    return scorer


def flagged_count(scores: DataFrame) -> DataFrame:
    """One row: scores in all and those flagged for the digest."""
    return scores.agg(
        F.count(F.lit(1)).alias("scored"), F.count_if("include_in_digest").alias("flagged")
    )
