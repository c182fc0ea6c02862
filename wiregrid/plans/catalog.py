"""The registered queries: every operator over the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wiregrid.functions import text, times
from wiregrid.functions.lexicon import EventKeywords, Lexicon
from wiregrid.operators import checks, digest, keyed, ledger, runlog, score, watchlists
from wiregrid.operators.clusters import (
    Clustering,
    cluster_articles,
    leader_of_articles,
    member_chunks,
)
from wiregrid.operators.normalize import (
    Normalized,
    counts_per_ticker,
    normalize,
    parse_raw,
    trailing_window,
)
from wiregrid.operators.rank import in_order
from wiregrid.operators.summaries import summarize
from wiregrid.plans.daily import Grouped, compose, group_articles, load_all, load_run
from wiregrid.session import configure, materialize, scratch_dir
from wiregrid.sources import buckets, defaults, derived, landing, tables
from wiregrid.sources.derived import spread, table
from wiregrid.streaming import first_wins
from wiregrid.streaming.ingest import ingest_new, recent_only

Query = Callable[[SparkSession, str], DataFrame]

# A lexicon of syllables the test prose is made of, so that every
# event type and both thresholds occur.
FIXTURE_LEXICON: Lexicon = (
    EventKeywords("earnings", ("thatth", "ngthe"), ("wither",)),
    EventKeywords("merger", ("ionthe", "andand"), ("ofthe", "lyou")),
    EventKeywords("regulation", ("reaux", "eauou"), ("tione", "menté")),
    EventKeywords("product", ("ichsch", "ungein"), ("verge", "undder")),
    EventKeywords("executive", ("ciónasí", "mente de"), ("osque", "rrar")),
    EventKeywords("legal", ("heredere", "wasthe"), ("shble",)),
    EventKeywords("macro", ("ananan", "ererer"), ("ntint", "onon")),
)

#: The moment the time-dependent queries look back from.
AS_OF = "2024-01-15 12:00:00"
EVENT_WATCHLIST = ("click", "view", "purchase", "refund")


def _stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after ingest, as the later steps find them in the store."""
    stored, _ = materialize(_normalized(spark, sf_dir).articles, "articles")
    return stored


def _normalized(spark: SparkSession, sf_dir: str) -> Normalized:
    documents = spread(table(spark, sf_dir, "documents"))
    return normalize(derived.raw_documents(documents))


def _grouped(spark: SparkSession, sf_dir: str) -> Grouped:
    return group_articles(_stored_articles(spark, sf_dir), FIXTURE_LEXICON)


def _moment() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of three deliveries: all, then the French, then the long ones with a new source."""
    first = _stored_articles(spark, sf_dir).withColumn("delivery", F.lit(0))
    french = first.where(F.col("headline").rlike("[éèê]")).withColumn("delivery", F.lit(1))
    long = first.where(F.length("summary") > 1000).withColumn("delivery", F.lit(2))
    again = french.unionByName(long).withColumn(
        "source", F.concat_ws("#", "source", F.col("delivery").cast("string"))
    )
    return first.unionByName(again)


# --- ingest -----------------------------------------------------------------


def articles_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).articles.select(
        "seq", "id", "ticker", "headline", "summary", "source", "url",
        F.unix_seconds("published_at").alias("published_ts"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
    )


def article_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = _normalized(spark, sf_dir).rejects
    return rejects.select("ticker", F.col("batch_pos").cast("long").alias("batch_pos"), "reason")


def pages_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select(
        "page_id",
        text.clean_html(F.col("html")).alias("clean_text"),
        text.clean_html(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"),
    )


def raw_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land raw batches, replace those of one source, read back in feed order, normalise."""
    path = f"{scratch_dir(spark)}/landing"
    documents = table(spark, sf_dir, "documents")
    raw = derived.raw_documents(documents)
    landing.write_landing(raw, path)
    resent = raw.where(F.col("ticker") == "src1")
    landing.write_landing(resent, path, resent.select("ticker", "fetch_date").distinct())
    watched = derived.watchlist_of(documents)
    batch = landing.in_feed_order(landing.read_landing(spark, path), watched)
    return normalize(batch).articles.select("id", "ticker", "headline", "url")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records taken up by a stream, file by file."""
    root = scratch_dir(spark)
    documents = table(spark, sf_dir, "documents")
    raw = derived.raw_documents(documents)
    landing.write_landing(raw, f"{root}/landing")
    watched = derived.watchlist_of(documents)
    query = ingest_new(spark, f"{root}/landing", watched, f"{root}/store", f"{root}/checkpoint")
    query.awaitTermination()
    stored = tables.read_appended(spark, f"{root}/store", "articles")
    return stored.select("id", "ticker", "headline", "url")


def stored_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream set aside, read from the store."""
    root = scratch_dir(spark)
    documents = table(spark, sf_dir, "documents")
    landing.write_landing(derived.raw_documents(documents), f"{root}/landing")
    watched = derived.watchlist_of(documents)
    ingest_new(
        spark, f"{root}/landing", watched, f"{root}/store", f"{root}/checkpoint"
    ).awaitTermination()
    rejects = tables.read_appended(spark, f"{root}/store", "article_rejects")
    return rejects.select("ticker", F.col("batch_pos").cast("long").alias("batch_pos"), "reason")


def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch files, several per source; those of src2 have bad tokens and open strings inside.

    Every second document of src2 is spoiled, in turn by a time that is no JSON and by a string
    that is never closed; the records around them are kept.
    """
    root = f"{scratch_dir(spark)}/json"
    raw = derived.raw_documents(table(spark, sf_dir, "documents"))
    whole, kind = F.col("raw_json"), F.pmod("seq", F.lit(4))
    spoiled = (
        F.when((F.col("ticker") != "src2") | (kind % 2 == 1), whole)
        .when(kind == 0, F.regexp_replace(whole, r'"datetime":[^,}]*\}$', '"datetime":nope}'))
        .otherwise(F.replace(whole, F.lit('"source":"src2"'), F.lit('"source":"src2')))
    )
    files = landing.batch_files(raw.withColumn("raw_json", spoiled), "2024-01-02")
    files.select("name", "value").write.partitionBy("name").text(root)
    parsed = landing.read_json_batches(spark, root, F.col("name"), pathGlobFilter="*")
    return parse_raw(parsed).groupBy(
        "ticker", F.coalesce("reason", F.lit("stored")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("records"))


def single_ticker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker's records of the landing area; the others' partitions are not read."""
    path = f"{scratch_dir(spark)}/landing"
    landing.write_landing(derived.raw_documents(table(spark, sf_dir, "documents")), path)
    raw = landing.read_landing(spark, path, ticker="src3")
    return raw.select("ticker", F.col("batch_pos").cast("long").alias("batch_pos"))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-sent articles dropped within the horizon of a stream."""
    root = scratch_dir(spark)
    sent = _resent(spark, sf_dir).select("id", "ticker", "published_at")
    sent.write.parquet(f"{root}/sent")
    stream = spark.readStream.schema(sent.schema).parquet(f"{root}/sent")
    query = (
        recent_only(stream)
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(sent.schema).parquet(f"{root}/out").select("id", "ticker")


def stream_state_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four deliveries 14 hours apart, a run of the stream for each: first wins within 24 hours.

    All articles, then the French, the long, and the French again. Every run takes up the state
    that the one before left.
    """
    root = scratch_dir(spark)
    sent, _ = materialize(_resent(spark, sf_dir).select("id", "seq", "delivery"), "deliveries")
    third = sent.where("delivery = 1").withColumn("delivery", F.lit(3))
    hours = F.make_interval(hours=F.lit(14) * F.col("delivery"))
    timed = sent.unionByName(third).withColumn("arrived", _moment() + hours)
    for delivery in range(4):
        batch = timed.where(F.col("delivery") == delivery)
        batch.write.parquet(f"{root}/sent/{delivery}")
        stream = spark.readStream.schema(timed.schema).parquet(f"{root}/sent/*")
        passed = first_wins.first_within(stream, "arrived", "seq", horizon=24 * 3600)
        first_wins.start(passed, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    stored = spark.read.schema(timed.schema).parquet(f"{root}/out")
    return stored.select("id", "seq", "delivery")


def trailing_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("at")
    )
    recent = trailing_window(events, "at", _moment())
    return counts_per_ticker(recent, derived.watchlist(spark, EVENT_WATCHLIST))


def ticker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "documents").select(F.col("source").alias("ticker"))
    return counts_per_ticker(batch, derived.watchlist(spark))


# --- tables -----------------------------------------------------------------


def articles_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after all deliveries when the first record of an id wins."""
    sent = _resent(spark, sf_dir)
    stored = keyed.first_per_key(sent.where(F.col("delivery") == 1), ["id"], [F.col("seq")])
    fresh = keyed.insert_or_ignore(
        sent.where(F.col("delivery") != 1), stored, ["id"], [F.col("delivery"), F.col("seq")]
    )
    return stored.unionByName(fresh).select("id", "source", "delivery")


def articles_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _resent(spark, sf_dir)
    stored = sent.where(F.col("delivery") == 0)
    return keyed.insert_or_replace(
        sent.where(F.col("delivery") > 0), stored, ["id"], [F.desc("delivery"), F.desc("seq")]
    ).select("id", "source", "delivery")


def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot after three deliveries, each of which rewrote its own keys' buckets."""
    root = scratch_dir(spark)
    sent, _ = materialize(_resent(spark, sf_dir).select("id", "source", "delivery", "seq"), "sent")
    for delivery in range(3):
        batch = sent.where(F.col("delivery") == delivery)
        buckets.merge(batch, root, "articles", delivery, ["id"], [F.desc("seq")])
    return buckets.read(spark, root, "articles", sent.schema).select("id", "source", "delivery")


def stored_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loosely typed digest rows as typed ones, gaps filled."""
    schema = StructType.fromDDL(
        "id string, sent_at timestamp, flagged boolean, article_ids array<string>, status string, "
        "subject string"
    )
    read = defaults.typed(derived.loose_digests(table(spark, sf_dir, "events")), schema)
    return read.select(
        "id", F.unix_seconds("sent_at").alias("sent_ts"), "flagged",
        F.array_join("article_ids", ",").alias("article_ids"), "status", "subject",
    )


def insert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _resent(spark, sf_dir)
    return keyed.insert_counts(
        sent.where(F.col("delivery") != 1), sent.where(F.col("delivery") == 1), ["id"]
    )


def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the quality of their label, where they have one."""
    stored = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return keyed.update_by_key(stored, labels, ["doc_id"], ["quality"])


def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    events = table(spark, sf_dir, "events")
    return checks.constraint_report(
        checks.duplicate_keys(documents, "documents", ["doc_id"]),
        checks.duplicate_keys(lineitem, "lineitem", ["l_orderkey", "l_linenumber"]),
        checks.duplicate_keys(events, "events", ["user_id", "event_type"]),
        checks.missing_values(documents, "documents", ["doc_id", "text", "source"]),
        checks.orphans(lineitem, "lineitem", "l_partkey", part, "p_partkey"),
        checks.orphans(
            labels, "labels", "doc_id", documents.where(F.col("lang") == "en"), "doc_id"
        ),
    )


# --- scoring ----------------------------------------------------------------


def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = score.lexicon_hits(_stored_articles(spark, sf_dir).select("id", "headline", "summary"))
    best = F.col("best")
    return hits.select(
        "id",
        F.col("total_high").cast("long").alias("total_high"),
        F.col("total_medium").cast("long").alias("total_medium"),
        best["high"].cast("long").alias("best_high"),
        best["medium"].cast("long").alias("best_medium"),
    )


def article_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_articles(_stored_articles(spark, sf_dir))


def article_scores_fixture_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_articles(_stored_articles(spark, sf_dir), FIXTURE_LEXICON)


def lexicon_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a lexicon that is a table: thousands of words of the conversations."""
    words = derived.word_lexicon(
        table(spark, sf_dir, "conversations"), [entry.event_type for entry in FIXTURE_LEXICON]
    )
    return score.score_articles(_stored_articles(spark, sf_dir), words)


def score_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score.score_articles(_stored_articles(spark, sf_dir), FIXTURE_LEXICON)
    return score.flagged_count(scores)


def custom_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python scorer over labels; it fails on toxic documents of low quality."""

    def score_one(article: dict) -> dict:
        importance = 40 * article["quality"] + 20 * article["toxic"]
        if importance == 20:
            raise ValueError("unusable")
        return {
            "is_relevant": bool(article["quality"]),
            "relevance_score": article["quality"] / 2,
            "importance_score": int(importance),
            "event_type": "legal" if article["toxic"] else "other",
            "confidence": "medium",
            "include_in_digest": importance >= 30,
            "reason": "label",
        }

    articles = derived.external_scores(table(spark, sf_dir, "labels"))
    scored = score.run_scorer(articles, score.python_scorer(score_one, ["quality", "toxic"]))
    good = scored.scores.select(
        "article_id", "relevance_score", "importance_score", "event_type", "include_in_digest",
        F.lit(None).cast("string").alias("error"),
    )
    bad = scored.rejects.select(
        "article_id",
        *[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in good.columns[1:-1]],
        F.col("reason").alias("error"),
    )
    return good.unionByName(bad)


# --- clusters ---------------------------------------------------------------


def _clustering(spark: SparkSession, sf_dir: str) -> Clustering:
    return cluster_articles(_stored_articles(spark, sf_dir))


def leader_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with the leader it joined and how similar their headlines are."""
    led = leader_of_articles(_stored_articles(spark, sf_dir))
    leaders = led.where(F.col("seq") == F.col("leader_seq")).select(
        F.col("seq").alias("leader_seq"), F.col("headline").alias("_lead")
    )
    return led.join(leaders, "leader_seq").select(
        "id",
        "leader_seq",
        F.round(text.text_similarity(F.col("headline"), F.col("_lead")), 6).alias("similarity"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustering(spark, sf_dir).clusters


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustering(spark, sf_dir).members


def cluster_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = member_chunks(_clustering(spark, sf_dir).members)
    return lists.select("cluster_id", "chunk", F.array_join("article_ids", ",").alias("article_ids"))


def cluster_ids_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id lists as JSON arrays."""
    chunks = member_chunks(_clustering(spark, sf_dir).members)
    return chunks.select("cluster_id", "chunk", F.to_json("article_ids").alias("article_ids"))


def clusters_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest clusters first, in feed order among those of one time, with their places."""
    made = F.timestamp_seconds(
        F.lit(derived.FIRST_PUBLISHED) + F.lit(600) * F.floor(F.col("cluster_seq") / 10)
    )
    found = _clustering(spark, sf_dir).clusters.withColumn("created_at", made)
    placed = in_order(found, [F.desc("created_at"), F.asc("cluster_seq")], "place")
    return placed.select(
        "place", "cluster_id", "cluster_seq", F.unix_seconds("created_at").alias("created_ts")
    )


def clusters_within_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines compared only with those of the same source."""
    found = cluster_articles(_stored_articles(spark, sf_dir), block_by=["ticker"]).clusters
    return found.select("cluster_id", "cluster_seq", "ticker", "article_count")


def part_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names: few words, many copies, crowded groups."""
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_brand").alias("ticker"),
        F.col("p_name").alias("headline"),
        F.col("p_partkey").alias("seq"),
    )
    return cluster_articles(parts).clusters


def turn_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns, whole texts as headlines."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("role").alias("ticker"),
        F.col("text").alias("headline"),
        # A turn is an int, so no two turns share a place.
        (F.shiftleft("conv_id", 31) + F.col("turn")).alias("seq"),
    )
    found = cluster_articles(turns, 0.5).clusters
    return found.select("cluster_id", "cluster_seq", "ticker", "article_count")


def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = _stored_articles(spark, sf_dir)
    found = cluster_articles(articles)
    return summarize(found.clusters, found.members, articles).select("cluster_id", "summary")


# --- digest -----------------------------------------------------------------


def cluster_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _grouped(spark, sf_dir)
    return digest.cluster_context(grouped.clusters, grouped.members, grouped.scores).drop(
        "representative_headline", "age"
    )


def top_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compose(_grouped(spark, sf_dir), derived.watchlist(spark))
    return made.top.select(
        "rank", "cluster_id", "ticker", "event_type", "importance_score", "summary"
    )


def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compose(_grouped(spark, sf_dir), derived.watchlist(spark))
    return made.sections.drop("representative_headline", "summary")


def digest_sections_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three clusters per ticker, flagged ones only."""
    made = compose(
        _grouped(spark, sf_dir), derived.watchlist(spark), per_ticker_limit=3, only_included=True
    )
    return made.sections.select("ticker", "position", "rank", "cluster_id", "note")


def digest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose(_grouped(spark, sf_dir), derived.watchlist(spark)).metrics


def digest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compose(_grouped(spark, sf_dir), derived.watchlist(spark))
    return digest.digest_text(
        digest.digest_lines(made.top, made.sections, made.metrics, _moment())
    )


def digest_texts_by_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every customer's watchlist, three clusters per ticker at most."""
    grouped = _grouped(spark, sf_dir)
    context, _ = materialize(
        digest.cluster_context(grouped.clusters, grouped.members, grouped.scores), "context"
    )
    entries = derived.customer_watchlists(table(spark, sf_dir, "customer"))
    return watchlists.digest_texts(
        context, grouped.scores, entries, _moment(), per_ticker_limit=3
    )


def digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger rows of those digests."""
    entries = derived.customer_watchlists(table(spark, sf_dir, "customer"))
    rows = watchlists.digest_rows(entries, _moment(), 7)
    return _dated(rows).select("id", "version", "run_date", "subject", "status")


def compose_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top stories of a digest composed from stored tables alone."""
    root = scratch_dir(spark)
    grouped = _grouped(spark, sf_dir)
    tables.append_new(grouped.scores, root, "article_scores", 0, "article_id")
    tables.write_snapshot(grouped.clusters, root, "event_clusters", 0)
    tables.write_snapshot(grouped.members, root, "cluster_members", 0)
    return compose(load_all(spark, root), derived.watchlist(spark)).top.select(
        "rank", "cluster_id", "article_count", "event_type", "importance_score"
    )


# --- ledger and run log -----------------------------------------------------


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.digest_ledger(table(spark, sf_dir, "orders"))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("run_date", F.col("run_date").cast("string"))


def latest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(ledger.latest_digest(_ledger(spark, sf_dir)))


def latest_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(ledger.latest_per_date(_ledger(spark, sf_dir)))


def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(ledger.current_state(_ledger(spark, sf_dir)))


def send_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _ledger(spark, sf_dir)
    candidates = ledger.current_state(book).where(F.col("status") == "composed")
    return _dated(ledger.send_decisions(candidates, book))


def status_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to append once every current digest was handed over for delivery."""
    book = _ledger(spark, sf_dir).withColumns(
        {"sent_at": F.lit(None).cast("timestamp"), "recipient": F.lit(None).cast("string")}
    )
    state = ledger.current_state(book)
    outcomes = state.select(
        "id",
        (F.col("version") + 1_000_000_000).alias("version"),
        F.when(F.col("version") % 3 == 0, True).when(F.col("version") % 3 == 1, False).alias("delivered"),
        _moment().alias("at"),
        F.lit("reader").alias("recipient"),
    )
    told = ledger.record_outcomes(book, outcomes)
    return _dated(told).withColumn(
        "sent_at", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss")
    ).select("id", "version", "run_date", "status", "sent_at", "recipient")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_summary(derived.run_log(table(spark, sf_dir, "events")))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of one run over all documents: fetched, stored, rejected, scored, clusters."""
    raw = derived.raw_documents(table(spark, sf_dir, "documents"))
    made = normalize(raw)
    stored, _ = materialize(made.articles, "articles")
    grouped = group_articles(stored, FIXTURE_LEXICON)
    counted = {
        "fetched": raw, "stored": stored, "rejected": made.rejects, "scored": grouped.scores,
        "clusters": grouped.clusters,
    }
    return runlog.counters(counted)


def quiet_run_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without news after one with news: its digest has no stories of the day before."""
    root = scratch_dir(spark)
    grouped = _grouped(spark, sf_dir)
    tables.append_new(grouped.scores, root, "article_scores", 0, "article_id")
    for version, keep in ((0, "true"), (1, "false")):
        tables.write_snapshot(grouped.clusters.where(keep), root, "event_clusters", version)
        tables.write_snapshot(grouped.members.where(keep), root, "cluster_members", version)
    runs = [
        compose(load_run(spark, root, version), derived.watchlist(spark)).top.select(
            F.lit(version).alias("version"), "rank", "cluster_id"
        )
        for version in (0, 1, 2)
    ]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.distinct_steps(derived.run_log(table(spark, sf_dir, "events")))


# --- scalar functions -------------------------------------------------------


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", text.slugify(F.col("text")).alias("slug"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations"))
    body = F.col("text")
    return turns.select(
        "conv_id",
        "turn",
        text.truncate(body, 60).alias("cut60"),
        text.truncate(body, 2).alias("cut2"),
        text.collapse_spaces(body).alias("flat"),
        F.array_join(text.words(body), " ").alias("words"),
        F.round(text.text_similarity(body, F.concat(F.col("role"), F.lit(" "), body)), 6).alias("similarity"),
    )


def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    return events.select(
        "event_id",
        times.timestamp_to_unix(at).alias("unix"),
        F.date_format(times.unix_to_timestamp(times.timestamp_to_unix(at)), "yyyy-MM-dd HH:mm:ss").alias("back"),
        times.long_date(at).alias("long_date"),
        times.minute_stamp(at).alias("minute"),
        digest.subject(at).alias("subject"),
        times.elapsed_ms(at, _moment()).alias("elapsed_ms"),
    )


_QUERIES: list[Query] = [
    articles_normalized, article_rejects, stored_rejects, json_ingest, single_ticker_scan,
    pages_clean_text, raw_ingest, stream_ingest, stream_state_dedupe,
    stream_dedupe, trailing_window_counts, ticker_counts,
    articles_first_wins, articles_last_wins, snapshot_merge, stored_defaults, insert_counts, keyed_update, constraint_report,
    lexicon_hits, article_scores, article_scores_fixture_lexicon,
    lexicon_table_scores, score_flags, custom_scorer,
    leader_similarity, clusters, cluster_members, cluster_id_lists, cluster_ids_json,
    clusters_within_ticker, clusters_by_age,
    part_clusters, turn_clusters, cluster_summaries,
    cluster_context, top_stories, digest_sections, digest_sections_limited, digest_metrics,
    digest_text, digest_texts_by_watchlist, digest_rows, compose_from_tables,
    latest_digest, latest_per_date, ledger_state, send_decisions, status_ledger,
    run_summary, run_steps, run_counters, quiet_run_digest,
    slugs, text_functions, time_functions,
]


def _registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {query.__name__: _registered(query) for query in _QUERIES}
