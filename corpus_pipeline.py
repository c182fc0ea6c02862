"""From raw documents to packed token sequences: five stages, each a stored table.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns the table that the next one works on. All but the last keep the columns
of `docs`. Results do not depend on partitioning.

What a stage stores on its way is removed when a later stage begins and nobody
holds its result any more, so that the disk never has the tables of all stages.
"""

from __future__ import annotations

import functools
import gc
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiregrid.llm import bestfit_pack, exact_radix, minhash_fss, quality_rules, suffix_bcr
from wiregrid.llm.common import table
from wiregrid.llm.queries import tokenizer_path
from wiregrid.session import drop_scratch, materialize, scratch_scope

#: Results of stages, while somebody holds them, and the folders they are read from.
_HELD: list[tuple[weakref.ref, list[str]]] = []


def _stage(work: Callable) -> Callable:
    """`work` as a stage that first drops the tables of earlier stages whose results are gone."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gc.collect()
        for held in [held for held in _HELD if held[0]() is None]:
            drop_scratch(spark, held[1])
            _HELD.remove(held)
        with scratch_scope() as folders:
            found = work(spark, docs, sf_dir)
        _HELD.append((weakref.ref(found), folders))
        return found

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.judge(docs).where("kept").select(*docs.columns)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    gone = exact_radix.deduplicate(docs.select("doc_id", "text")).where("NOT kept")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    met = docs.withColumn("_text", F.sha2(exact_radix.normalised().cast("binary"), 256))
    same = met["doc_id"].eqNullSafe(gone["_id"]) & (met["_text"] == gone["_sha"])
    return met.join(gone.hint("merge"), same, "left_anti").select(*docs.columns)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    found = minhash_fss.near_components(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that a smaller document has too are cut out; a character cut in two is replaced."""
    left = suffix_bcr.cut_repeats(docs)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    cut = F.when(F.col("n_removed") > 0, text).otherwise(F.col("text"))
    new = {"text": cut, "n_chars": F.length(cut).cast("long")}
    return left.select(*[new[c].alias(c) if c in new else c for c in docs.columns])


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    pieces = bestfit_pack.cut_pieces(docs, tokenizer_path("word_bpe_49k.json"))
    return bestfit_pack.pack(pieces)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("suffix-array dedup", passages),
    ("best-fit packing", packing),
]

#: The stages cannot be expressed in SQL; a test holds them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs, _ = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
