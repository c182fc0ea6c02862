"""Keyword lexicons: event types in order, each with strong and weak keywords."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple


class EventKeywords(NamedTuple):
    event_type: str
    high: tuple[str, ...]
    medium: tuple[str, ...]


Lexicon = tuple[EventKeywords, ...]

# Scoring results depend on these words and on the order of the types.
DEFAULT_LEXICON: Lexicon = (
    EventKeywords(
        "earnings",
        (
            "earnings", "revenue", "profit", "eps", "quarterly results",
            "beat estimates", "missed estimates", "guidance", "outlook",
            "fiscal year", "annual results", "net income", "operating income",
        ),
        (
            "financial results", "q1", "q2", "q3", "q4", "full year",
            "sales", "margin", "forecast", "analyst",
        ),
    ),
    EventKeywords(
        "merger",
        (
            "acquisition", "merger", "takeover", "buyout", "deal",
            "acquire", "acquired", "purchase agreement", "bid",
        ),
        (
            "partnership", "joint venture", "strategic alliance",
            "consolidation", "combine",
        ),
    ),
    EventKeywords(
        "regulation",
        (
            "sec", "ftc", "doj", "antitrust", "fine", "penalty",
            "regulatory", "compliance", "investigation", "subpoena",
            "lawsuit", "settlement", "consent decree",
        ),
        (
            "regulation", "regulator", "government", "congress",
            "legislation", "policy", "rule", "ban",
        ),
    ),
    EventKeywords(
        "product",
        (
            "launch", "release", "unveil", "announce", "new product",
            "iphone", "chip", "gpu", "ai model", "software update",
            "version", "upgrade",
        ),
        (
            "product", "feature", "update", "platform", "service",
            "technology", "innovation",
        ),
    ),
    EventKeywords(
        "executive",
        (
            "ceo", "cfo", "cto", "coo", "president", "resign",
            "appoint", "hire", "fired", "step down", "departure",
            "succession",
        ),
        (
            "executive", "leadership", "management", "board",
            "director", "officer",
        ),
    ),
    EventKeywords(
        "legal",
        (
            "lawsuit", "sued", "litigation", "court", "judge",
            "verdict", "damages", "patent", "infringement", "class action",
        ),
        (
            "legal", "attorney", "counsel", "dispute", "claim",
            "allegation", "complaint",
        ),
    ),
    EventKeywords(
        "macro",
        (
            "federal reserve", "fed", "interest rate", "inflation",
            "recession", "gdp", "unemployment", "tariff", "trade war",
            "geopolitical",
        ),
        (
            "economy", "economic", "market", "sector", "industry",
            "global", "macro",
        ),
    ),
)

# What a score may hold.
EVENT_TYPES = (
    "earnings", "merger", "regulation", "product", "executive", "legal", "macro", "other",
)
CONFIDENCE_LEVELS = ("low", "medium", "high")

#: A lexicon of more keywords than this is matched by an index instead of being part of the plan.
PLAN_KEYWORDS = 2_000


def lexicon_from_rows(rows: Iterable[tuple[str, str, str]]) -> Lexicon:
    """Build a lexicon from (event_type, weight_class, keyword) rows in order."""
    types: dict[str, dict[str, list[str]]] = {}
    for event_type, weight_class, keyword in rows:
        types.setdefault(event_type, {"high": [], "medium": []})[weight_class].append(keyword)
    return tuple(EventKeywords(t, tuple(k["high"]), tuple(k["medium"])) for t, k in types.items())


def keyword_count(lexicon: Lexicon) -> int:
    return sum(len(entry.high) + len(entry.medium) for entry in lexicon)
