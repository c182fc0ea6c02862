"""Lexicon scoring as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiregrid.functions.lexicon import Lexicon

RELEVANCE_THRESHOLD = 0.4
IMPORTANCE_THRESHOLD = 30


def score_text(headline: Column, summary: Column) -> Column:
    return F.lower(F.concat(F.coalesce(headline, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """How many distinct keywords occur in the text, as substrings."""
    # A sum of plain comparisons stays in generated code; a filter over an array would not.
    found = [F.contains(text, F.lit(word)).cast("int") for word in keywords]
    return reduce(lambda left, right: left + right, found, F.lit(0))


def hits_by_type(text: Column, lexicon: Lexicon) -> Column:
    """Array in lexicon order of (high, medium, rank, event_type), ready for a maximum.

    `rank` falls along the lexicon, so that equal hits go to the earlier type.
    """
    return F.array(
        *[
            F.struct(
                keyword_hits(text, entry.high).alias("high"),
                keyword_hits(text, entry.medium).alias("medium"),
                F.lit(-order).alias("rank"),
                F.lit(entry.event_type).alias("event_type"),
            )
            for order, entry in enumerate(lexicon)
        ]
    )


def total(hits: Column, field: str) -> Column:
    return F.aggregate(hits, F.lit(0), lambda acc, hit: acc + hit[field])


def best_hit(hits: Column) -> Column:
    return F.array_max(hits)


def event_type(best: Column) -> Column:
    nothing = (best["high"] == 0) & (best["medium"] == 0)
    return F.when(nothing, F.lit("other")).otherwise(best["event_type"])


def relevance(total_high: Column, total_medium: Column) -> Column:
    return F.least(F.lit(1.0), (2 * total_high + total_medium) / F.lit(10.0))


def importance(best: Column) -> Column:
    return F.least(F.lit(100), 20 * best["high"] + 5 * best["medium"]).cast("int")


def confidence(best: Column) -> Column:
    return (
        F.when(best["high"] >= 2, F.lit("high"))
        .when((best["high"] == 1) | (best["medium"] >= 2), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def reason(is_relevant: Column, included: Column, kind: Column, best: Column) -> Column:
    # The sentences of an explanation.
    opening = F.when(included, F.lit("Material company-specific update.")).otherwise(
        F.lit("Relevant but below importance threshold.")
    )
    told = F.format_string(
        "%s Event type: %s. High-signal keywords: %d, medium: %d.",
        opening, kind, best["high"], best["medium"],
    )
    return F.when(is_relevant, told).otherwise(
        F.lit("No significant stock-relevant keywords detected.")
    )
