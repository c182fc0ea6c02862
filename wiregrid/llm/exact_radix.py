"""Exact duplicates by most-significant-digit radix partitioning of the texts.

Every round splits each group of documents by the next bytes of their texts.
A group that is left with one document is done; documents that end inside the
round with the same bytes are equal. So texts are compared byte by byte, and no
digest decides. The first round takes few bytes, each later one four times as
many, so the number of rounds follows the logarithm of the longest text, and
a byte of a text is shuffled in one round only.

Counts and minima are combined before the shuffle: a group that holds a third
of all rows sends one row per task. Members find their group's row again by a
join, whose skew Spark splits.

Defined results: a null text counts as empty; empty texts are equal. Rows that
share a doc_id are rows of their own; a group keeps every row that has its
smallest doc_id. A null doc_id sorts last and is kept only in a group without
any other. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrid.llm.common import SPACE, text_of
from wiregrid.session import materialize


def normalised(column: str = "text") -> Column:
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(text_of(column), SPACE, " ")


def _chunk(rest: Column, width: int) -> Column:
    return F.substring(rest, 1, width)


def groups(docs: DataFrame, first: int = 48, growth: int = 4) -> DataFrame:
    """(doc_id, text_sha256, keep_id, group_size) of every row; the digest is output only.

    `docs` has doc_id and text. A group's number is made up when its row is
    written, once; a written table is what later rounds read.
    """
    text = normalised()
    width = first
    state = docs.select(
        "doc_id",
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.lit(0).cast("long").alias("gid"),
        text.cast("binary").alias("rest"),
    )
    settled: list[DataFrame] = []
    while True:
        digit = _chunk(F.col("rest"), width)
        ended = F.octet_length(F.col("rest")) <= width
        found, seen = materialize(
            state.groupBy("gid", digit.alias("digit"), ended.alias("ended"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep_id"))
            .where("n > 1")
            .select("*", F.monotonically_increasing_id().alias("next")),
            "radix-groups",
            F.count_if(~F.col("ended")).alias("open"),
        )
        # The groups grow with the documents, so the plan is one that does not need them small.
        met = state.withColumns({"digit": digit, "ended": ended}).join(
            found.hint("merge"), ["gid", "digit", "ended"], "left"
        )
        split = met.select(
            "doc_id", "text_sha256", "n", "keep_id", F.col("next").alias("gid"),
            (F.col("n").isNull() | F.col("ended")).alias("done"),
            F.when(F.col("n").isNotNull() & ~F.col("ended"),
                   F.substring(F.col("rest"), width + 1, 2**31 - 1)).alias("rest"),
        )
        table, _ = materialize(split, "radix-state", partition_by=["done"])
        settled.append(
            table.where("done").select(
                "doc_id", "text_sha256",
                F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            )
        )
        if not seen["open"]:
            break
        state = table.where("NOT done").select("doc_id", "text_sha256", "gid", "rest")
        width *= growth
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of `docs`."""
    return groups(docs).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
