"""Secret scans by an incremental ledger of content-addressed blobs.

A text is a blob, named by the SHA-256 of its bytes; a path (a document, or one
historical version of it) points to a blob. The ledger holds a row per scanned
blob: the rules it was scanned with, each by name and version, and the spans
found. A scan reads only texts of blobs that the ledger does not have with every
rule asked for, each distinct blob once, with the missing rules only, and adds
their rows. Findings then go back to every path that holds the blob.

Every ledger row is whole by itself, so a scan that is lost half way leaves
nothing wrong behind: blobs without a row are scanned again, rows that two scans
wrote count once. Copies of a text are made one inside each task before the
shuffle, so a text that a third of all paths hold is no hot key.

Defined results: a null text is the empty blob and has no spans. Places count
code points; bytes that are not UTF-8 count as one replacement character each
as Python decodes them. Repeated rows are paths of their own, null keys
included. An empty table gives an empty result and leaves the ledger as it is.
Other columns are kept under their own names by `scan(keep=...)` only; `blob`
and `found` are the names added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiregrid.llm.common import batches_of, text_of
from wiregrid.session import materialize

_LEDGER = (
    "blob binary, rules array<string>, "
    "found array<struct<rule: string, start: int, `end`: int>>"
)
#: Of unseen blobs, so many names (32 bytes each) are broadcast to sort out known texts early.
BROADCAST_BLOBS = 100_000


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches, from left to right and apart, are findings.

    A match counts if its `group` (0: all of it) has `least` characters. A change of any of these
    asks for a new `version`, under which blobs are scanned again.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The patterns that every scan must have.
BASE = (
    Rule(
        "assign", 1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, any_case=True,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", 1, r"[0-9a-f]+", least=24),
)
#: Further kinds: heads of private keys and signed web tokens.
RULES = (
    *BASE,
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)


def spans(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    """(start, end) of what a rule finds in a text."""
    return [
        m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]


def _scan(rows: Iterator[pa.RecordBatch], rules: Sequence[Rule]) -> Iterator[pa.RecordBatch]:
    known = {rule.key: (rule, rule.compiled()) for rule in rules}
    kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch, texts in batches_of(rows, "text"):
        pending = batch.column("pending").to_pylist()
        found = []
        for raw, keys in zip(texts, pending, strict=True):
            text = raw.decode("utf-8", "replace")
            found.append(
                [
                    {"rule": key, "start": a, "end": b}
                    for key in keys
                    for a, b in spans(text, *known[key])
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column("blob"), batch.column("pending"), pa.array(found, kind)],
            names=["blob", "rules", "found"],
        )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The rows of a ledger folder; none if nothing was ever written there."""
    try:
        return spark.read.schema(_LEDGER).parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def unseen(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, pending): blobs of `paths` with the keys of rules they were not scanned with."""
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    scanned = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("scanned"))
    none = F.array().cast("array<string>")
    return (
        paths.select("blob").distinct().join(scanned, "blob", "left")
        .select("blob", F.array_except(wanted, F.coalesce("scanned", none)).alias("pending"))
        .where(F.size("pending") > 0)
    )


def scan(
    versions: DataFrame,
    ledger: str,
    rules: Sequence[Rule] = RULES,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Every row of `versions` with its `blob` and what `rules` find in it, in order of place.

    `ledger` is a folder that all executors reach; what is new is added to it. `found` is an array
    of (rule, start, end), by start and then in the order of `rules`.
    """
    spark = versions.sparkSession
    raw = text_of(text).cast("binary")
    blobs = versions.select(
        F.struct(*[F.col(c) for c in keep]).alias("path"),
        F.unhex(F.sha2(raw, 256)).alias("blob"),
        F.col(text).alias("text"),
    )
    paths, _ = materialize(blobs.drop("text"), "paths")
    new, seen = materialize(unseen(paths, read_ledger(spark, ledger), rules), "unseen-blobs")
    if seen["rows"]:
        if seen["rows"] <= BROADCAST_BLOBS:
            blobs = blobs.join(F.broadcast(new.select("blob")), "blob", "left_semi")
        texts = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        found = texts.join(new, "blob").mapInArrow(partial(_scan, rules=list(rules)), _LEDGER)
        found.write.mode("append").parquet(ledger)

    place = F.create_map(*[F.lit(x) for i, rule in enumerate(rules) for x in (rule.key, i)])
    name = F.create_map(*[F.lit(x) for rule in rules for x in (rule.key, rule.name)])
    wanted = [rule.key for rule in rules]
    hits = (
        read_ledger(spark, ledger).where(F.size("found") > 0)
        .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    )
    ordered = F.array_sort(
        F.transform(
            F.filter("found", lambda x: x["rule"].isin(wanted)),
            lambda x: F.struct(
                x["start"].alias("start"), place[x["rule"]].alias("place"),
                x["end"].alias("end"), name[x["rule"]].alias("rule"),
            ),
        )
    )
    listed = F.transform(ordered, lambda x: F.struct(x["rule"], x["start"], x["end"]))
    none = F.array().cast("array<struct<rule: string, start: int, `end`: int>>")
    return paths.join(hits.select("blob", listed.alias("found")), "blob", "left").select(
        *[F.col("path").getField(c).alias(c) for c in keep],
        "blob", F.coalesce("found", none).alias("found"),
    )


def spelled(found, kinds: Sequence[str] | None = None):
    """Findings as `kind:start:end`, joined by commas; of some kinds only if given."""
    if kinds is not None:
        found = F.filter(found, lambda x: x["rule"].isin(list(kinds)))
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ","
    )
