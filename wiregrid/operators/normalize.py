"""Raw records to articles: typed, cleaned, identified; malformed ones set aside."""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrid.functions import ids, times
from wiregrid.functions.text import clean_html, strip
from wiregrid.schemas import FEED_ORDER
from wiregrid.session import settle


class Normalized(NamedTuple):
    articles: DataFrame
    rejects: DataFrame


# Bits of watchlist position and of batch position inside `seq`: whole ints, above them the day.
_PLACE_BITS = 31


def feed_order(
    fetch_date: Column, position: Column, batch_pos: Column, tickers: int = 1 << 20
) -> Column:
    """One decimal that sorts by day, then watchlist position, then place in the batch.

    It has room for every date and every int, so two records never share a number. A negative
    place or a watchlist position beyond `tickers` is an error.
    """
    day = F.unix_date(fetch_date).cast("decimal(10,0)")
    ticker, place = position.cast("long"), batch_pos.cast("long")
    fits = ticker.between(0, tickers - 1) & place.between(0, (1 << _PLACE_BITS) - 1)
    inside = (F.shiftleft(ticker, _PLACE_BITS) + place).cast("decimal(19,0)")
    seq = (day * F.lit(Decimal(1 << 2 * _PLACE_BITS)) + inside).cast(FEED_ORDER)
    return F.when(
        ~fits, F.raise_error(F.lit("a feed place is out of range")).cast(FEED_ORDER)
    ).otherwise(seq)


def _field(record: Column, name: str) -> tuple[Column, Column]:
    """JSON type and text of a field; the type is null where the field is missing."""
    value = F.try_variant_get(record, f"$.{name}", "variant")
    return F.schema_of_variant(value), F.try_variant_get(record, f"$.{name}", "string")


def _is_empty(kind: Column, text: Column) -> Column:
    """Missing, null, and the values that count as nothing."""
    return (
        kind.isNull()
        | kind.isin("VOID", "ARRAY<VOID>", "OBJECT<>")
        | ((kind != "STRING") & text.isin("0", "0.0", "false"))
    )


def _unix_seconds(kind: Column, text: Column) -> Column:
    whole = text.try_cast("bigint")
    fraction = text.try_cast("double")
    truncated = F.when(F.abs(fraction) < 9.2e18, fraction.cast("bigint"))
    return (
        F.when(kind.isin("STRING", "BIGINT"), whole)
        .when(kind == "BOOLEAN", (text == "true").cast("bigint"))
        .when((kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"), truncated)
    )


def parse_raw(raw: DataFrame, drop_script: bool = False) -> DataFrame:
    """All columns of `raw` (`ticker`, `raw_json`, ...) with the article fields and `reason`.

    `reason` is null for a good record. Where `raw` tells whether a record's ticker is `watched`,
    one that is not has a reason.
    """
    parsed = raw.withColumn("_record", F.try_parse_json("raw_json"))
    fields = [F.schema_of_variant("_record").alias("_kind")]
    for name in ("headline", "summary", "source", "url", "datetime"):
        kind, text = _field(F.col("_record"), name)
        fields += [kind.alias(f"_{name}_kind"), text.alias(f"_{name}_text")]
    opened = settle(parsed, *fields).drop("_record")

    def text_of(name: str) -> Column:
        kind, text = F.col(f"_{name}_kind"), F.col(f"_{name}_text")
        return F.when(_is_empty(kind, text), F.lit("")).otherwise(text)

    def not_text(name: str, *accepted: str) -> Column:
        kind, text = F.col(f"_{name}_kind"), F.col(f"_{name}_text")
        return ~_is_empty(kind, text) & ~kind.isin("STRING", *accepted)

    seconds = _unix_seconds(F.col("_datetime_kind"), F.col("_datetime_text"))
    typed = opened.withColumn("published_ts", seconds)
    reason = (
        F.when(F.col("_kind").isNull(), F.lit("not JSON"))
        .when(~F.startswith("_kind", F.lit("OBJECT")), F.lit("not an object"))
        .when(F.col("_datetime_kind").isNull(), F.lit("datetime missing"))
        .when(F.col("published_ts").isNull(), F.lit("datetime not an integer"))
        .when(~times.unix_in_range(F.col("published_ts")), F.lit("datetime out of range"))
        .when(not_text("headline"), F.lit("headline not text"))
        .when(not_text("summary"), F.lit("summary not text"))
        .when(not_text("source"), F.lit("source not text"))
        .when(not_text("url", "BIGINT"), F.lit("url not text"))
    )
    if "watched" in raw.columns:
        reason = reason.when(F.col("ticker").isNull(), F.lit("ticker missing")).when(
            ~F.col("watched"), F.lit("ticker not watched")
        )
    good_ts = F.when(times.unix_in_range(F.col("published_ts")), F.col("published_ts"))
    texts = typed.select(
        *raw.columns,
        "published_ts",
        reason.alias("reason"),
        *[text_of(name).alias(f"_{name}") for name in ("headline", "summary", "source", "url")],
        times.unix_to_timestamp(good_ts).alias("published_at"),
    )
    return texts.select(
        *raw.columns,
        "reason",
        ids.article_id(F.col("ticker"), F.col("_url"), F.col("published_ts")).alias("id"),
        clean_html(F.col("_headline"), drop_script).alias("headline"),
        clean_html(F.col("_summary"), drop_script).alias("summary"),
        strip(F.col("_source")).alias("source"),
        F.col("_url").alias("url"),
        "published_at",
    )


_ARTICLE = [
    "id", "ticker", "headline", "summary", "source", "url", "published_at", "raw_json", "seq",
]


def normalize(raw: DataFrame, as_of: Column | None = None, drop_script: bool = False) -> Normalized:
    """Articles and rejects of a raw batch (`ticker`, `batch_pos`, `raw_json`, `seq`).

    Nothing is shuffled. `as_of` fills `fetched_at` when given.
    """
    parsed = parse_raw(raw, drop_script)
    fetched = [] if as_of is None else [as_of.alias("fetched_at")]
    articles = parsed.where(F.col("reason").isNull()).select(*_ARTICLE, *fetched)
    rejects = parsed.where(F.col("reason").isNotNull()).select(
        *[c for c in ("ticker", "batch_pos", "raw_json") if c in raw.columns], "reason"
    )
    return Normalized(articles, rejects)


def trailing_window(df: DataFrame, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows of the `hours` up to `as_of`, both ends included."""
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    return df.where(F.col(ts).between(start, as_of))


def counts_per_ticker(batch: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(ticker, position, fetched) for every watched ticker, 0 where nothing came."""
    counted = batch.groupBy("ticker").agg(F.count(F.lit(1)).alias("_rows"))
    return watchlist.join(counted, "ticker", "left").select(
        "ticker", "position", F.coalesce("_rows", F.lit(0)).cast("long").alias("fetched")
    )
