"""Digest runs as an append-only ledger of versions, and what to send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrid.functions import ids
from wiregrid.operators.digest import subject
from wiregrid.operators.keyed import first_per_key


def composed_digest(metrics: DataFrame, watchlist_id: str, as_of: Column, version: int) -> DataFrame:
    """The ledger row of a freshly composed digest, from its one row of metrics."""
    run_date = F.to_date(as_of)
    return metrics.select(
        ids.digest_id(F.lit(watchlist_id), run_date).alias("id"),
        F.lit(version).cast("long").alias("version"),
        run_date.alias("run_date"),
        subject(as_of).alias("subject"),
        F.lit(None).cast("timestamp").alias("sent_at"),
        F.lit(None).cast("string").alias("recipient"),
        F.lit("composed").alias("status"),
    )


def composed_text(text: DataFrame, watchlist_id: str, as_of: Column, version: int) -> DataFrame:
    """The text of a composed digest, in parts to be read in order."""
    return text.select(
        ids.digest_id(F.lit(watchlist_id), F.to_date(as_of)).alias("id"),
        F.lit(version).cast("long").alias("version"),
        "text_part",
        F.col("text").alias("text_content"),
    )


def current_state(ledger: DataFrame) -> DataFrame:
    """The newest version of every digest."""
    return first_per_key(ledger, ["id"], [F.desc("version")])


def latest_digest(ledger: DataFrame) -> DataFrame:
    """The digest of the latest date, of those the newest; no row if there is none."""
    return ledger.orderBy(F.desc("run_date"), F.desc("version")).limit(1)


def digest_for_date(ledger: DataFrame, run_date: Column) -> DataFrame:
    return latest_digest(ledger.where(F.col("run_date") == run_date))


def latest_per_date(ledger: DataFrame) -> DataFrame:
    return first_per_key(ledger, ["run_date"], [F.desc("version")])


def sent_dates(ledger: DataFrame) -> DataFrame:
    """Dates on which some version was sent."""
    return ledger.where(F.col("status") == "sent").select("run_date").distinct()


def send_decisions(
    candidates: DataFrame, ledger: DataFrame, force: bool = False, dry_run: bool = False
) -> DataFrame:
    """(id, run_date, decision): `send`, `skip` on a date already sent, `hold` in a dry run."""
    sent = sent_dates(ledger).withColumn("_sent", F.lit(True))
    decision = F.when(F.lit(force) | F.col("_sent").isNull(), F.lit("send")).otherwise(F.lit("skip"))
    joined = candidates.join(sent, "run_date", "left")
    return joined.select(
        "id", "run_date", (F.lit("hold") if dry_run else decision).alias("decision")
    )


def record_outcomes(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ledger rows to append for deliveries (`id`, `version`, `delivered`, `at`, `recipient`).

    `delivered` is true for sent, false for failed and null for skipped.
    """
    status = (
        F.when(F.col("delivered"), F.lit("sent"))
        .when(~F.col("delivered"), F.lit("failed"))
        .otherwise(F.lit("skipped"))
    )
    tried = F.col("delivered").isNotNull()
    told = outcomes.select(
        "id",
        F.col("version").cast("long").alias("version"),
        F.when(F.col("delivered"), F.col("at")).alias("sent_at"),
        F.when(tried, F.col("recipient")).alias("recipient"),
        status.alias("status"),
    )
    carried = current_state(ledger).drop("version", "sent_at", "recipient", "status")
    return carried.join(told, "id").select(*ledger.columns)
