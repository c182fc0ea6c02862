"""Deterministic identifiers: the first 16 hex digits of a SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest16(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def article_id(ticker: Column, url: Column, published_ts: Column) -> Column:
    return _digest16(ticker, url, published_ts.cast("string"))


def cluster_id(first_article: Column, members: Column, ticker: Column) -> Column:
    return _digest16(first_article, members.cast("string"), ticker)


def digest_id(watchlist: Column, run_date: Column) -> Column:
    return _digest16(watchlist, run_date.cast("string"))
