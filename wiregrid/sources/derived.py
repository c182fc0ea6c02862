"""Feeds read off the general-purpose tables (documents, events, orders, labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiregrid.session import materialize

# When the first document was published and how far apart they are.
FIRST_PUBLISHED, STEP_SECONDS = 1_704_067_200, 60

#: Watched sources, and one that never publishes.
WATCHLIST = tuple(f"src{i}" for i in range(10)) + ("src99",)

_BLOCKS = 4_096  # of sources, numbered apart


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores when its scan has fewer splits than that; else untouched.

    For work that is heavy per row. A large table has splits enough and is
    never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def watchlist(spark: SparkSession, tickers: tuple[str, ...] = WATCHLIST) -> DataFrame:
    rows = [(ticker, position) for position, ticker in enumerate(tickers)]
    return spark.createDataFrame(rows, "ticker string, position int")


def watchlist_of(documents: DataFrame) -> DataFrame:
    """Every source of the documents with a position, in blocks of a hash and by name inside."""
    sources = (
        documents.where(F.col("source").isNotNull())
        .select(F.col("source").alias("ticker"))
        .distinct()
        .withColumn("_block", F.pmod(F.xxhash64("ticker"), F.lit(_BLOCKS)))
    )
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sources.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("ticker"))
    watched, _ = materialize(
        sources.withColumn("_inside", inside)
        .join(starts, "_block")
        .select("ticker", (F.col("_start") + F.col("_inside") - 1).cast("int").alias("position")),
        "watchlist",
    )
    return watched


def raw_documents(documents: DataFrame) -> DataFrame:
    """Documents as raw records: the first line is the headline, the rest the summary.

    Spanish documents without a line break give no usable time; German ones
    give theirs as text.
    """
    text = F.col("text")
    cut = F.instr(text, "\n")
    published = FIRST_PUBLISHED + STEP_SECONDS * F.col("doc_id")
    stamp = (
        F.when((F.col("lang") == "es") & (cut == 0), F.lit('"n/a"'))
        .when(F.col("lang") == "de", F.concat(F.lit('" '), published.cast("string"), F.lit('"')))
        .otherwise(published.cast("string"))
    )
    record = F.to_json(
        F.struct(
            F.when(cut > 0, F.left(text, cut - 1)).otherwise(text).alias("headline"),
            F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).alias("summary"),
            F.col("source").alias("source"),
            F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        )
    )
    # The time is appended as JSON text, so that its JSON type can differ by record.
    whole = F.concat(F.rtrim(record, F.lit("}")), F.lit(',"datetime":'), stamp, F.lit("}"))
    return documents.select(
        F.col("source").alias("ticker"),
        F.to_date(F.timestamp_seconds(published)).alias("fetch_date"),
        # A batch is one source's records of one day; a place in it is an int.
        F.pmod("doc_id", F.lit(1 << 31)).cast("int").alias("batch_pos"),
        whole.alias("raw_json"),
        F.col("doc_id").alias("seq"),
    )


def digest_ledger(orders: DataFrame) -> DataFrame:
    """Orders as digest versions: one digest per customer and day, a version per order."""
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("sent"))
        .when(F.col("o_orderstatus") == "P", F.lit("failed"))
        .otherwise(F.lit("composed"))
    )
    run_date = F.to_date("o_orderdate")
    return orders.select(
        F.concat_ws("-", F.col("o_custkey") % 7, run_date).alias("id"),
        F.col("o_orderkey").alias("version"),
        run_date.alias("run_date"),
        F.concat(F.lit("Digest "), F.col("o_orderpriority")).alias("subject"),
        status.alias("status"),
    )


def run_log(events: DataFrame) -> DataFrame:
    """Events as run-log rows: a run per user and day, errors as failed steps."""
    steps = F.array(*[F.lit(s) for s in ("fetch", "normalize", "score", "cluster", "compose")])
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.concat_ws("-", "user_id", F.to_date(at)).alias("run_id"),
        F.element_at(steps, (F.col("event_id") % 5 + 1).cast("int")).alias("step"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.floor(F.col("value") * 1000).alias("duration_ms"),
        F.col("event_type").alias("message"),
        at.alias("logged_at"),
    )


def word_lexicon(conversations: DataFrame, event_types: list[str]) -> DataFrame:
    """The words of at least eight letters in conversations as a lexicon, dealt to the types by their letters."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{8,}"), F.lit(0)))
    words = conversations.select(word.alias("keyword")).distinct()
    size = F.char_length("keyword")
    without_e = F.char_length(F.replace("keyword", F.lit("e"), F.lit("")))
    without_a = F.char_length(F.replace("keyword", F.lit("a"), F.lit("")))
    place = F.pmod(size + 3 * without_e, F.lit(len(event_types)))
    names = F.array(*[F.lit(name) for name in event_types])
    return words.select(
        F.element_at(names, place + 1).alias("event_type"),
        F.when(without_a % 3 == 0, F.lit("high")).otherwise(F.lit("medium")).alias("weight_class"),
        "keyword",
        place.cast("long").alias("position"),
    )


def loose_digests(events: DataFrame) -> DataFrame:
    """Events as digest rows of a store that keeps everything as text, with gaps."""
    shown = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("+02:00")), (F.col("event_id") % 3 + 1).cast("int"))
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_id") % 7 > 0, F.concat(shown, zone)).alias("sent_at"),
        F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 2).cast("string")).alias("flagged"),
        F.when(F.col("event_id") % 4 > 0, F.to_json(F.array(F.col("event_type"), F.lit("x")))).alias("article_ids"),
        F.when(F.col("event_type") == "purchase", F.lit("sent")).alias("status"),
    )


def customer_watchlists(customers: DataFrame) -> DataFrame:
    """A watchlist per customer: one to five of 25 sources, the last five of which never publish."""
    places = F.sequence(F.lit(0).cast("long"), F.pmod("c_custkey", F.lit(5)).cast("long"))
    return customers.select("c_custkey", F.explode(places).alias("position")).select(
        F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("watchlist_id"),
        F.concat(
            F.lit("src"), F.pmod(F.col("c_custkey") + F.col("position"), F.lit(25)).cast("string")
        ).alias("ticker"),
        F.col("position").cast("int").alias("position"),
    )


def external_scores(labels: DataFrame) -> DataFrame:
    """Labels as articles for an external scorer."""
    return labels.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), "quality", "toxic"
    )
