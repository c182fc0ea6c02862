"""One digest per watchlist, from one shared context.

What a digest tells of a ticker is the same for everyone who watches it, so a
ticker's section is ranked and put into words once, in pieces of bounded size,
and only then handed out to the watchlists. A ticker in very many watchlists is
handed out by many tasks: its watchlists are dealt over salts, and its pieces
are copied to each salt. Pieces are numbered per watchlist in blocks, so a
watchlist of very many tickers is no task of its own either.

Defined results: a watchlist may name a ticker once; of repeated entries the
first position counts. Entries without a watchlist or ticker are left out. A
watched ticker without news has a note. Of the digest, the parts before and
after the sections are the same for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrid.functions import ids
from wiregrid.operators import digest
from wiregrid.operators.rank import rank_in_group
from wiregrid.session import materialize

ENTRIES = "watchlist_id string, ticker string, position int"
#: Lines in a piece, pieces in a row of text, and watchlists served by a task, at most.
PIECE_LINES, PART_PIECES, LISTS_PER_SALT = 1_000, 1_000, 10_000


def ticker_pieces(
    context: DataFrame, per_ticker_limit: int | None = None, piece_lines: int = PIECE_LINES
) -> DataFrame:
    """(ticker, piece, text): the section of every ticker with news, in pieces of some lines."""
    ranked = rank_in_group(
        context, ["ticker"], [-F.col("importance_score"), F.col("age")], "cluster_seq", "rank", start=1
    )
    if per_ticker_limit is not None:
        ranked = ranked.where(F.col("rank") <= per_ticker_limit)
    head = F.when(F.col("rank") == 1, digest.ticker_head(F.col("ticker")))
    lines = F.array_compact(F.array(head, *digest.section_story()))
    # A story has at most three lines.
    told = ranked.select(
        "ticker", "rank", F.array_join(lines, "\n").alias("text"),
        F.floor((F.col("rank") - 1) * 3 / piece_lines).alias("piece"),
    )
    return told.groupBy("ticker", "piece").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n"
        ).alias("text")
    )


def handed_out(
    pieces: DataFrame, entries: DataFrame, lists_per_salt: int = LISTS_PER_SALT
) -> DataFrame:
    """(watchlist_id, position, ticker, piece, text) of every entry, a note where there is no news."""
    known = entries.where("watchlist_id IS NOT NULL AND ticker IS NOT NULL")
    once = known.groupBy("watchlist_id", "ticker").agg(F.min("position").alias("position"))
    once, _ = materialize(once, "entries")
    fans = once.groupBy("ticker").agg(
        F.ceil(F.count(F.lit(1)) / lists_per_salt).cast("int").alias("fan")
    )
    copies = pieces.join(fans, "ticker").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))
    )
    # Tickers in more lists than one salt serves are fewer than entries / lists_per_salt.
    wide = F.broadcast(fans.where("fan > 1"))
    dealt = once.join(wide, "ticker", "left").withColumn(
        "salt", F.pmod(F.xxhash64("watchlist_id"), F.coalesce("fan", F.lit(1))).cast("int")
    )
    met = dealt.drop("fan").join(copies.drop("fan"), ["ticker", "salt"], "left")
    quiet = F.concat_ws(
        "\n", digest.ticker_head(F.col("ticker")), *digest.note_lines(F.lit(digest.NO_UPDATES))
    )
    return met.select(
        "watchlist_id", "position", "ticker", F.coalesce("piece", F.lit(0)).cast("long").alias("piece"),
        F.coalesce("text", quiet).alias("text"),
    )


def digest_texts(
    context: DataFrame,
    scores: DataFrame,
    entries: DataFrame,
    as_of: Column,
    max_top_stories: int = digest.MAX_TOP_STORIES,
    per_ticker_limit: int | None = None,
    part_pieces: int = PART_PIECES,
    **sizes,
) -> DataFrame:
    """(watchlist_id, text_part, text): the digest of every watchlist, to be read in order of parts."""
    pieces = ticker_pieces(context, per_ticker_limit, sizes.pop("piece_lines", PIECE_LINES))
    body = handed_out(pieces, entries, **sizes)
    metrics, _ = materialize(digest.digest_metrics(context, scores), "metrics")
    top = digest.top_stories(context, max_top_stories)
    no_sections = digest.digest_sections(
        context.limit(0), entries.limit(0).select("ticker", "position")
    )
    # What all digests share: a row of totals and a few top stories, whatever the size of the tables.
    shared = sorted(
        (r.part, r.position, r.rank, r.line, r.text)
        for r in digest.digest_lines(top, no_sections, metrics, as_of).collect()
    )
    last = max(row[0] for row in shared)
    head = "\n".join(row[-1] for row in shared if row[0] < last)
    tail = "\n".join(row[-1] for row in shared if row[0] == last)
    # Entries of one position come by ticker; pieces by number. The places fit one long per ticker.
    placed = rank_in_group(body, ["watchlist_id"], [F.col("position"), F.col("ticker")], "piece", "place")
    placed, _ = materialize(placed.select("watchlist_id", "place", "text"), "pieces")
    last_of = placed.groupBy("watchlist_id").agg(F.max("place").alias("_last"))
    part = F.floor(F.col("place") / part_pieces)
    parts = placed.groupBy("watchlist_id", part.alias("text_part")).agg(
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("_pieces"),
        F.max("place").alias("_upto"),
    )
    whole = F.transform("_pieces", lambda x: x["text"])
    first, end = F.col("text_part") == 0, F.col("_upto") == F.col("_last")
    framed = F.concat(
        F.when(first, F.array(F.lit(head))).otherwise(F.array().cast("array<string>")),
        whole,
        F.when(end, F.array(F.lit(tail))).otherwise(F.array().cast("array<string>")),
    )
    return parts.join(last_of, "watchlist_id").select(
        "watchlist_id", "text_part", F.array_join(framed, "\n").alias("text")
    )


def digest_rows(entries: DataFrame, as_of: Column, version: int) -> DataFrame:
    """The ledger row of every watchlist's freshly composed digest."""
    run_date = F.to_date(as_of)
    lists = entries.where("watchlist_id IS NOT NULL AND ticker IS NOT NULL")
    return lists.select("watchlist_id").distinct().select(
        ids.digest_id(F.col("watchlist_id"), run_date).alias("id"),
        F.lit(version).cast("long").alias("version"),
        run_date.alias("run_date"),
        digest.subject(as_of).alias("subject"),
        F.lit(None).cast("timestamp").alias("sent_at"),
        F.lit(None).cast("string").alias("recipient"),
        F.lit("composed").alias("status"),
    )
