"""Digest tables: cluster context, top stories, sections, metrics and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiregrid.functions import times
from wiregrid.operators.rank import rank_in_group

MAX_TOP_STORIES = 5
#: Lines per row of an assembled text.
PART_LINES = 10_000

# Wording and layout of the plain-text digest.
SUBJECT_PREFIX = "📈 Stock News Digest"
NO_UPDATES = "No major updates in the last 24 hours."
RULE, THIN_RULE = "=" * 80, "-" * 80
TITLE, TOP_TITLE = "STOCK NEWS DIGEST — ", "🔥 TOP STORIES"
SECTIONS_TITLE, TAIL_TITLE = "PER-TICKER UPDATES", "METRICS & DISCLAIMER"
COUNTS = ("articles processed", "events", "relevant")
LABELS = ("Articles fetched : ", "Relevant         : ", "Clusters         : ", "Generated        : ")
DISCLAIMER = (
    "DISCLAIMER: This digest is generated automatically from public news sources for",
    "informational purposes only. It does not constitute financial advice. Always do",
    "your own research before making investment decisions.",
)


def cluster_context(
    clusters: DataFrame, members: DataFrame, scores: DataFrame, only_included: bool = False
) -> DataFrame:
    """Clusters with the event type and importance of their best-scored member.

    Of equal scores the earliest member's counts. `only_included` keeps the
    clusters with a member flagged for the digest. Clusters of several runs
    carry an `age`, which puts newer ones first among equals.
    """
    rated = members.join(
        scores.select("article_id", "event_type", "importance_score", "include_in_digest"),
        "article_id",
        "left",
    )
    best = rated.groupBy("cluster_id").agg(
        F.max(
            F.when(
                F.col("importance_score").isNotNull(),
                F.struct("importance_score", (-F.col("member_pos")).alias("early"), "event_type"),
            )
        ).alias("_best"),
        F.count(F.lit(1)).alias("article_count"),
        F.coalesce(F.bool_or("include_in_digest"), F.lit(False)).alias("_flagged"),
    )
    joined = clusters.drop("article_count").join(best, "cluster_id", "left")
    if only_included:
        joined = joined.where(F.col("_flagged"))
    return joined.select(
        "cluster_id",
        "cluster_seq",
        "ticker",
        "representative_headline",
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("article_count", F.lit(0)).cast("long").alias("article_count"),
        F.coalesce("_best.event_type", F.lit("other")).alias("event_type"),
        F.coalesce("_best.importance_score", F.lit(0)).alias("importance_score"),
        F.lit("").alias("url"),
        F.lit("").alias("source"),
        (F.col("age") if "age" in clusters.columns else F.lit(0).cast("long")).alias("age"),
    )


def top_stories(context: DataFrame, limit: int = MAX_TOP_STORIES) -> DataFrame:
    """The most important clusters, watched or not, with their `rank`."""
    order = [F.desc("importance_score"), F.col("age"), F.col("cluster_seq")]
    first = context.orderBy(*order).limit(limit)
    # Ranks only the few rows that the limit left.
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def digest_sections(
    context: DataFrame, watchlist: DataFrame, per_ticker_limit: int | None = None
) -> DataFrame:
    """Clusters of every watched ticker, ranked; a note where a ticker has none."""
    watched = context.join(watchlist, "ticker")
    if per_ticker_limit is None:
        ranked = rank_in_group(
            watched, ["ticker"], [-F.col("importance_score"), F.col("age")], "cluster_seq",
            "rank", start=1,
        )
    else:
        window = Window.partitionBy("ticker").orderBy(
            F.desc("importance_score"), "age", "cluster_seq"
        )
        ranked = watched.withColumn("rank", F.row_number().over(window)).where(
            F.col("rank") <= per_ticker_limit
        )
    columns = [
        "ticker", "position", "rank", "cluster_id", "representative_headline", "summary",
        "article_count", "event_type", "importance_score",
    ]
    told = ranked.withColumn("rank", F.col("rank").cast("long")).select(
        *columns, F.lit(None).cast("string").alias("note")
    )
    seen = context.select("ticker").distinct()
    quiet = watchlist.join(seen, "ticker", "left_anti").select(
        "ticker",
        "position",
        F.lit(0).cast("long").alias("rank"),
        *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in columns[3:]],
        F.lit(NO_UPDATES).alias("note"),
    )
    return told.unionByName(quiet)


def digest_metrics(context: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of totals; relevant articles are counted over all scores."""
    of_clusters = context.select(
        "article_count", F.lit(1).alias("cluster"), F.lit(0).alias("relevant")
    )
    of_scores = scores.select(
        F.lit(0).cast("long").alias("article_count"),
        F.lit(0).alias("cluster"),
        F.when(F.col("include_in_digest"), 1).otherwise(0).alias("relevant"),
    )

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    return of_clusters.unionByName(of_scores).agg(
        total("article_count").alias("total_articles"),
        total("relevant").alias("relevant_articles"),
        total("cluster").alias("total_clusters"),
    )


def subject(as_of: Column) -> Column:
    return F.concat(F.lit(f"{SUBJECT_PREFIX} — "), times.long_date(as_of))


# Parts of the text, in order.
_HEAD, _TOP, _MIDDLE, _SECTIONS, _TAIL = range(5)
_LINE = "part int, position int, rank bigint, line int, text string"


def _lines(rows: DataFrame, part: int, position: Column, rank: Column, texts: list[Column]):
    """One row per text; null texts are left out."""
    listed = F.posexplode(F.array(*texts)).alias("line", "text")
    return (
        rows.select(
            F.lit(part).alias("part"),
            position.cast("int").alias("position"),
            rank.cast("long").alias("rank"),
            listed,
        )
        .where(F.col("text").isNotNull())
    )


def _story(mark: Column, with_sources: bool) -> list[Column]:
    """The lines of a cluster."""
    lit, none = F.lit, F.lit(None).cast("string")
    head = F.concat(
        mark, lit("["), F.upper("event_type"), lit("] "), F.col("representative_headline")
    )
    told = F.when(F.col("summary") != "", F.concat(lit("  "), F.col("summary")))
    many = F.concat(lit("  ("), F.col("article_count").cast("string"), lit(" sources)"))
    sources = F.when(F.col("article_count") > 1, many) if with_sources else none
    return [head, F.concat(F.coalesce(told, lit("")), F.coalesce(sources, lit("")))]


def ticker_head(ticker: Column) -> Column:
    return F.concat(F.lit("--- "), ticker, F.lit(" ---"))


def note_lines(note: Column) -> list[Column]:
    return [F.concat(F.lit("  "), note), F.lit("")]


def section_story() -> list[Column]:
    """The lines of a cluster in its ticker's section."""
    return _story(F.lit("• "), True)


def digest_lines(
    top: DataFrame, sections: DataFrame, metrics: DataFrame, as_of: Column
) -> DataFrame:
    """Every line of the plain-text digest with its place: part, position, rank, line."""
    lit = F.lit

    def metric(label: str, value: Column) -> Column:
        return F.concat(lit(label), value.cast("string"))

    zero = lit(0)
    counts = F.concat(
        F.col("total_articles").cast("string"), lit(f" {COUNTS[0]} · "),
        F.col("total_clusters").cast("string"), lit(f" {COUNTS[1]} · "),
        F.col("relevant_articles").cast("string"), lit(f" {COUNTS[2]}"),
    )
    title = F.concat(lit(TITLE), times.long_date(as_of))
    head = _lines(metrics, _HEAD, zero, zero, [lit(RULE), title, lit(RULE), counts, lit("")])
    first = F.col("rank") == 1
    top_head = [F.when(first, lit(text)) for text in (THIN_RULE, TOP_TITLE, THIN_RULE)]
    stories = _lines(
        top, _TOP, zero, F.col("rank"),
        top_head + _story(F.concat(lit("["), F.col("ticker"), lit("] ")), False),
    )
    middle = _lines(
        metrics, _MIDDLE, zero, zero, [lit(RULE), lit(SECTIONS_TITLE), lit(RULE)]
    )
    starts = F.when(F.col("rank") <= 1, ticker_head(F.col("ticker")))
    quiet = F.col("note").isNotNull()
    told = [F.when(~quiet, text) for text in section_story()]
    notes = [F.when(quiet, text) for text in note_lines(F.col("note"))]
    body = _lines(
        sections, _SECTIONS, F.col("position"), F.col("rank"), [starts, *told, *notes]
    )
    tail = _lines(
        metrics, _TAIL, zero, zero,
        [
            lit(RULE), lit(TAIL_TITLE), lit(RULE),
            metric(LABELS[0], F.col("total_articles")),
            metric(LABELS[1], F.col("relevant_articles")),
            metric(LABELS[2], F.col("total_clusters")),
            F.concat(lit(LABELS[3]), times.minute_stamp(as_of)),
            lit(""),
            *[lit(text) for text in DISCLAIMER],
            lit(RULE),
        ],
    )
    return head.unionByName(stories).unionByName(middle).unionByName(body).unionByName(tail)


def digest_text(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """The text in rows of at most `part_lines` lines: (text_part, text), to be read in order.

    A digest of usual size is one row. Lines are numbered block by block, so
    that a digest of any size is put together by many tasks.
    """
    # A story has at most 16 lines: rank and line make one number per part and ticker.
    place = lines.withColumn("_seq", F.col("rank") * 16 + F.col("line")).withColumn("_all", F.lit(0))
    numbered = rank_in_group(
        place, ["_all"], [F.col("part"), F.col("position")], "_seq", "line_no"
    )
    grouped = numbered.groupBy(F.floor(F.col("line_no") / part_lines).alias("text_part")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_lines")
    )
    return grouped.select(
        "text_part", F.array_join(F.transform("_lines", lambda pair: pair["text"]), "\n").alias("text")
    )
