"""The daily job over stored tables: ingest, score, group, summarise, compose, decide."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wiregrid.functions.lexicon import DEFAULT_LEXICON, Lexicon
from wiregrid.operators import digest, ledger
from wiregrid.operators.clusters import DEFAULT_THRESHOLD, cluster_articles
from wiregrid.operators.keyed import first_per_key
from wiregrid.operators.normalize import normalize
from wiregrid.operators.score import Scorer, run_scorer, score_articles
from wiregrid.operators.simjoin import Tuning
from wiregrid.operators.summaries import summarize
from wiregrid.schemas import RUN_LOGS
from wiregrid.session import materialize
from wiregrid.sources import tables
from wiregrid.sources.landing import in_feed_order


class Grouped(NamedTuple):
    scores: DataFrame
    clusters: DataFrame  # with summary
    members: DataFrame


class Digest(NamedTuple):
    top: DataFrame
    sections: DataFrame
    metrics: DataFrame


def group_articles(
    articles: DataFrame,
    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON,
    threshold: float = DEFAULT_THRESHOLD,
    block_by: list[str] | None = None,
    scorer: Scorer | None = None,
    tuning: Tuning = Tuning(),
) -> Grouped:
    """Scores, summarised clusters and members of articles with unique ids."""
    scores = run_scorer(articles, scorer).scores if scorer else score_articles(articles, lexicon)
    clusters, members = cluster_articles(articles, threshold, block_by, tuning)
    return Grouped(scores, summarize(clusters, members, articles), members)


def compose(
    grouped: Grouped,
    watchlist: DataFrame,
    max_top_stories: int = digest.MAX_TOP_STORIES,
    per_ticker_limit: int | None = None,
    only_included: bool = False,
) -> Digest:
    """The tables behind one digest."""
    context, _ = materialize(
        digest.cluster_context(grouped.clusters, grouped.members, grouped.scores, only_included),
        "context",
    )
    return Digest(
        digest.top_stories(context, max_top_stories),
        digest.digest_sections(context, watchlist, per_ticker_limit),
        digest.digest_metrics(context, grouped.scores),
    )


class DailyRun:
    """One run over a store: every step writes its table and a run-log row.

    Tables are append-only or snapshots numbered by `version`, so a step that
    is run again replaces its own output. Identifiers and times come from the
    arguments, never from the clock or chance.
    """

    def __init__(
        self, spark: SparkSession, store: str, watchlist: DataFrame, as_of: datetime, version: int
    ) -> None:
        self.spark, self.store, self.watchlist = spark, store, watchlist
        self.version = version
        self.run_id = f"{as_of:%Y-%m-%d}-{version}"
        self.as_of = F.lit(f"{as_of:%Y-%m-%d %H:%M:%S}").cast("timestamp")
        self._stamp = as_of
        self.steps: list[tuple] = []
        #: What the steps counted, by name.
        self.counters: dict[str, int] = {}

    def _step(self, name: str, work: Callable[[], dict[str, int]]) -> bool:
        """Do a step; its row of the run log tells what it counted, or why it failed."""
        start = time.monotonic()
        try:
            counted = work()
            status, message = "ok", " ".join(f"{k}={v}" for k, v in counted.items())
            self.counters |= counted
        except Exception as exc:  # a failed step is recorded; the caller decides what follows
            status, message = "error", f"{type(exc).__name__}: {exc}"
        took = int((time.monotonic() - start) * 1000)
        self.steps.append(
            (self.run_id, len(self.steps), name, status, took, message, self._stamp)
        )
        return status == "ok"

    def ingest(self, raw: DataFrame) -> bool:
        """Store the new articles of a raw batch (`ticker, fetch_date, batch_pos, raw_json`).

        The step "fetch" takes the batch over, "normalize" stores articles and rejects.
        """
        taken: dict[str, DataFrame] = {}

        def fetch() -> dict[str, int]:
            taken["raw"], seen = materialize(raw, "batch")
            return {"fetched": seen["rows"]}

        def store() -> dict[str, int]:
            articles, rejects = normalize(in_feed_order(taken["raw"], self.watchlist), self.as_of)
            stored, refused = Observation(), Observation()
            tables.append_new(
                articles, self.store, "articles", self.version, "seq", within="published_at",
                seen=stored,
            )
            tables.append(
                rejects.observe(refused, F.count(F.lit(1)).alias("rows")),
                self.store, "article_rejects", self.version,
            )
            return {"stored": stored.get["rows"], "rejected": refused.get["rows"]}

        return self._step("fetch", fetch) and self._step("normalize", store)

    def group(
        self, lexicon: Lexicon | DataFrame = DEFAULT_LEXICON, threshold: float = DEFAULT_THRESHOLD,
        scorer: Scorer | None = None, hours: int = 24,
    ) -> bool:
        """Score, cluster and summarise the articles of the trailing window, a step each.

        Clusters do not need scores: a scorer that fails leaves them as they are. Counts come from
        the writes themselves.
        """
        stored = tables.read_appended(self.spark, self.store, "articles")
        start = self.as_of - F.make_dt_interval(hours=F.lit(hours))
        recent = stored.where(F.col("published_at").between(start, self.as_of))
        found: dict[str, DataFrame] = {}

        def score() -> dict[str, int]:
            counts = {"rejected": 0}
            if scorer:
                # The scorer runs once; scores and rejects are read from what it wrote.
                scored = run_scorer(recent, lambda articles: materialize(scorer(articles), "scored")[0])
                refused = Observation()
                tables.append(
                    scored.rejects.observe(refused, F.count(F.lit(1)).alias("rows")),
                    self.store, "score_rejects", self.version,
                )
                scores, counts["rejected"] = scored.scores, refused.get["rows"]
            else:
                scores = score_articles(recent, lexicon)
            rated, seen = materialize(
                scores, "scores", F.count_if("include_in_digest").alias("flagged")
            )
            tables.append_new(
                rated.withColumn("scored_at", self.as_of), self.store, "article_scores",
                self.version, "article_id",
            )
            return {"scored": seen["rows"], **counts, "flagged": seen["flagged"]}

        def cluster() -> dict[str, int]:
            clusters, members = cluster_articles(recent, threshold)
            seen = Observation()
            tables.write_snapshot(
                members.observe(seen, F.count(F.lit(1)).alias("rows")),
                self.store, "cluster_members", self.version,
            )
            found["clusters"] = clusters
            held = Observation()
            self._write_clusters(clusters.observe(held, F.count(F.lit(1)).alias("rows")))
            return {"articles": seen.get["rows"], "clusters": held.get["rows"]}

        def summarise() -> dict[str, int]:
            members = tables.read_snapshot(
                self.spark, self.store, "cluster_members", self.version, exact=True
            )
            told, seen = materialize(summarize(found["clusters"], members, recent), "summaries")
            self._write_clusters(told)
            return {"summaries": seen["rows"]}

        scored = self._step("score", score)
        grouped = self._step("cluster", cluster) and self._step("summarize", summarise)
        return scored and grouped

    def _write_clusters(self, clusters: DataFrame) -> None:
        tables.write_snapshot(
            clusters.withColumn("created_at", self.as_of), self.store, "event_clusters", self.version
        )

    def compose(
        self, watchlist_id: str = "default", compose_only: bool = False, **options
    ) -> bool:
        """Compose the digest of this run, or with `compose_only` of all that is stored."""

        def work() -> dict[str, int]:
            stored = (
                load_all(self.spark, self.store)
                if compose_only
                else load_run(self.spark, self.store, self.version)
            )
            made = compose(stored, self.watchlist, **options)
            metrics, _ = materialize(made.metrics, "metrics")
            totals = metrics.first().asDict()
            lines = digest.digest_lines(made.top, made.sections, metrics, self.as_of)
            place = (watchlist_id, self.as_of, self.version * 2)
            tables.append(
                ledger.composed_text(digest.digest_text(lines), *place),
                self.store, "digest_texts", self.version,
            )
            tables.append(
                ledger.composed_digest(metrics, *place), self.store, "digest_runs", self.version * 2
            )
            return totals

        return self._step("compose", work)

    def decide(self, force: bool = False, dry_run: bool = False) -> DataFrame:
        """What to do with the latest digest: send, skip or hold."""
        runs = tables.read_appended(self.spark, self.store, "digest_runs")
        return ledger.send_decisions(ledger.latest_digest(runs), runs, force, dry_run)

    def record(self, outcomes: DataFrame) -> None:
        """Append what became of the digests handed over for delivery."""
        def work() -> dict[str, int]:
            runs = tables.read_appended(self.spark, self.store, "digest_runs")
            told, seen = materialize(ledger.record_outcomes(runs, outcomes), "outcomes")
            tables.append(told, self.store, "digest_runs", self.version * 2 + 1)
            return {"outcomes": seen["rows"]}

        self._step("send", work)

    def finish(self) -> str:
        """Write the run log and return the status of the run."""
        bad = {step for _, _, step, status, *_ in self.steps if status == "error"}
        status = "failed" if bad & {"fetch", "compose"} else "partial" if bad else "success"
        took = sum(step[4] for step in self.steps)
        self.steps.append(
            (self.run_id, len(self.steps), "pipeline", status, took,
             f"run {status}: {len(bad)} of {len(self.steps)} steps failed", self._stamp)
        )
        rows = self.spark.createDataFrame(self.steps, RUN_LOGS)
        tables.append(rows, self.store, "run_logs", self.version)
        return status


def _stored_scores(spark: SparkSession, store: str) -> DataFrame:
    scores = tables.read_appended(spark, store, "article_scores")
    return first_per_key(scores, ["article_id"], [F.col("scored_at")])


def load_run(spark: SparkSession, store: str, version: int | None = None) -> Grouped:
    """The clusters of run `version` (the newest, if not given) with the scores of their members.

    A run that has stored no clusters has none, whatever earlier runs have stored.
    """
    exact = version is not None
    members = tables.read_snapshot(spark, store, "cluster_members", version, exact)
    scores = _stored_scores(spark, store).join(members.select("article_id"), "article_id", "left_semi")
    clusters = tables.read_snapshot(spark, store, "event_clusters", version, exact)
    return Grouped(scores, clusters, members)


def load_all(spark: SparkSession, store: str) -> Grouped:
    """The clusters of all runs and all scores; of clusters with one id the newest counts."""
    clusters = first_per_key(
        tables.read_snapshots(spark, store, "event_clusters"), ["cluster_id"], [F.desc("snapshot")]
    ).withColumn("age", -F.col("snapshot"))
    members = tables.read_snapshots(spark, store, "cluster_members").join(
        clusters.select("cluster_id", "snapshot"), ["cluster_id", "snapshot"], "left_semi"
    )
    return Grouped(
        _stored_scores(spark, store), clusters.drop("snapshot"), members.drop("snapshot")
    )
