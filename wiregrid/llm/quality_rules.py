"""Quality rules with thresholds learned per language and source.

Every text gets plain counts. Those that are out of any proportion fail a base
rule. For the rest, each ratio (word length, symbols, repeated lines, repeated
words) is held against limits that come from the texts of the same language
and source: a histogram with cells of at most 1/64 relative width is counted
per language and source. Such histograms add up, so they are combined before
the shuffle, and up the levels (language and source, language, all) without a
second look at the texts. A limit is the median plus a multiple of the distance
between the median and an outer quantile.

Only DataFrame functions are used: no Python runs on the executors.

Defined results: a null or empty text has no words and fails the base rule.
Null languages and sources are groups of their own. Repeated rows are judged
row by row. Columns other than the three named are kept and never read, but
for those that the result adds, which are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wiregrid.llm.common import SPACE, text_of
from wiregrid.session import materialize

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules.

    min_words, most_repeated: the base rule (repeated words in percent).
    outer: the quantile, in thousandths, whose distance from the median is the
        unit of spread; its mirror image serves for lower limits.
    spreads: how many such units a text may lie from the median.
    slack: added to the spread of each ratio, in that ratio's own unit.
    min_rows: a level with fewer texts than this takes the limits of the level above it.
    """

    min_words: int = 50
    most_repeated: int = 50
    outer: int = 900
    spreads: int = 4
    slack: tuple[tuple[str, int], ...] = (
        ("word_length", 100),
        ("symbols", 50),
        ("dup_lines", 100),
        ("repeats", 50),
    )
    min_rows: int = 100


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = ("base_failed", "kept")


def _by_hash(hashes: Column) -> Column:
    """Windows as (hash, place), equal ones as neighbours; none if no hash is repeated."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(ordered)


def _repeat_words(words: Column, ordered: Column) -> Column:
    """Words lying in a 3-word window that occurs twice or more.

    The words of neighbours are compared, so a shared hash is no repeat.
    `ordered` must be a column: it is looked up once per element.
    """

    def same(a: Column, b: Column) -> Column:
        texts = F.slice(words, a["i"] + 1, 3) == F.slice(words, b["i"] + 1, 3)
        return F.coalesce((a["h"] == b["h"]) & texts, F.lit(False))

    repeated = F.filter(
        ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1))
    )
    return F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).alias("n"), (p + 3).alias("end")
        ),
        lambda acc: acc["n"],
    )


def counts(docs: DataFrame, keep: list[str], column: str = "text") -> DataFrame:
    """The columns `keep` of `docs` with the plain counts of every whole text, as long."""
    text, words = text_of(column), F.col("_words")
    split = docs.select(
        F.struct(*keep).alias("_row"),
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    none = F.array().cast("array<bigint>")
    hashed = split.withColumn("_hashes", F.when(F.size(words) >= 3, windows).otherwise(none))
    return hashed.withColumn("_ordered", _by_hash(F.col("_hashes"))).select(
        *[F.col("_row")[c].alias(c) for c in keep],
        F.size(words).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(words, F.col("_ordered")).cast("long").alias("n_repeat_words"),
    )


#: Each ratio as a whole number: characters per 100 words, the others per 1,000 words.
RATIOS = {
    "word_length": "word_chars * 100 div greatest(n_words, 1)",
    "symbols": "n_symbols * 1000 div greatest(n_words, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_words, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
}
#: A whole number with only its seven leading bits: the lower end of its histogram cell.
CELL = (
    "shiftleft(shiftright(value, greatest(length(bin(value)) - 7, 0)),"
    " greatest(length(bin(value)) - 7, 0))"
)


def sketches(judged: DataFrame) -> DataFrame:
    """Histograms (level, lang, source, ratio, cell, n) of the texts that passed the base rule.

    Level 0 is language and source, 1 the language, 2 all.
    """
    pairs = ", ".join(f"'{name}', {formula}" for name, formula in RATIOS.items())
    long = judged.where("NOT base_failed").select(
        "lang", "source", F.expr(f"stack({len(RATIOS)}, {pairs}) AS (ratio, value)")
    )
    own = long.groupBy("lang", "source", "ratio", F.expr(CELL).alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )
    own, _ = materialize(own, "quality-cells")
    none = F.lit(None).cast("string")

    def level(k: int, lang: Column, source: Column) -> DataFrame:
        return own.select(
            F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"),
            "ratio", "cell", "n",
        )

    levels = level(0, F.col("lang"), F.col("source")).unionByName(level(1, F.col("lang"), none))
    levels = levels.unionByName(level(2, none, none))
    keys = ["level", "lang", "source", "ratio", "cell"]
    return levels.groupBy(*keys).agg(F.sum("n").alias("n"))


def limits(cells: DataFrame, rules: Rules) -> DataFrame:
    """(level, lang, source, n, limits): the limits of every group, a map by ratio.

    A group's histogram has a bounded number of cells, whatever the group's size.
    """
    group = Window.partitionBy("level", "lang", "source", "ratio")
    ranked = cells.select(
        "*",
        (F.sum("n").over(group.orderBy("cell")) * 1000).alias("below"),
        F.sum("n").over(group).alias("total"),
    )

    def at(thousandths: int) -> Column:
        return F.min(F.when(F.col("below") >= F.col("total") * thousandths, F.col("cell")))

    marks = ranked.groupBy("level", "lang", "source", "ratio").agg(
        F.max("total").alias("total"),
        at(1000 - rules.outer).alias("down"),
        at(500).alias("mid"),
        at(rules.outer).alias("up"),
    )
    slack = F.create_map(*[F.lit(x) for pair in rules.slack for x in pair])[F.col("ratio")]
    k = rules.spreads
    bounds = F.struct(
        (F.col("mid") - k * (F.col("mid") - F.col("down") + slack)).alias("low"),
        (F.col("mid") + k * (F.col("up") - F.col("mid") + slack)).alias("high"),
    )
    return marks.groupBy("level", "lang", "source").agg(
        F.max("total").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("ratio", bounds.alias("bounds")))).alias(
            "limits"
        ),
    )


def judge(
    docs: DataFrame, rules: Rules = Rules(), keep: list[str] | None = None, column: str = "text"
) -> DataFrame:
    """The columns `keep` of `docs` (all, if not given) with COUNTS, `base_failed` and `kept`."""
    added = {*COUNTS, *VERDICTS}
    own = [c for c in (keep or docs.columns) if c not in added]
    carried = list(dict.fromkeys([*own, "lang", "source"]))
    base_failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words")
    )
    judged, _ = materialize(
        counts(docs, carried, column).withColumn("base_failed", base_failed), "quality-counts"
    )
    found, _ = materialize(limits(sketches(judged), rules), "quality-limits")
    whole = found.where("level = 2 AND n >= %d" % rules.min_rows).select("limits").first()
    by_lang = found.where("level = 1 AND n >= %d" % rules.min_rows)
    by_source = found.where("level = 0 AND n >= %d" % rules.min_rows)
    if whole is None:
        return judged.select(*own, *COUNTS, "base_failed", (~F.col("base_failed")).alias("kept"))
    overall = F.create_map(
        *[
            x
            for name, (low, high) in sorted(whole["limits"].items())
            for x in (
                F.lit(name),
                F.struct(F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high")),
            )
        ]
    )
    lang, source = F.col("lang"), F.col("source")
    met = judged.join(
        by_source.select(lang.alias("_l0"), source.alias("_s0"), F.col("limits").alias("_0")),
        lang.eqNullSafe(F.col("_l0")) & source.eqNullSafe(F.col("_s0")),
        "left",
    ).join(
        by_lang.select(lang.alias("_l1"), F.col("limits").alias("_1")),
        lang.eqNullSafe(F.col("_l1")),
        "left",
    ).withColumn("_limits", F.coalesce("_0", "_1", overall))
    fair = ~F.col("base_failed")
    for name, formula in RATIOS.items():
        bounds = F.col("_limits")[name]
        fair = fair & F.expr(formula).between(bounds["low"], bounds["high"])
    return met.select(*own, *COUNTS, "base_failed", fair.alias("kept"))
