"""Lexicons of any size: keywords found by an index of their rarest character grams.

Every keyword is filed under one of its grams (runs of `gram` characters; a
shorter keyword is its own gram), the one that the texts hold least often. The
grams of the texts meet the index in a join, which gives each text the few
keywords it may hold, and only these are looked for in it. Nothing of the
lexicon is part of the plan, so its size is that of a table.

A keyword counts once per row of the lexicon if it occurs in the text as a
substring, as with a lexicon that is part of the plan. The empty keyword occurs
in every text. Rows without a keyword count for nothing; a weight class other
than high and medium is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiregrid.functions import scoring
from wiregrid.functions.lexicon import Lexicon
from wiregrid.session import materialize, settle

LEXICON = "event_type string, weight_class string, keyword string, position long"
#: Characters of a gram. A longer one is rarer, and more of them are told apart.
GRAM = 8
#: Grams of keywords whose hashes are broadcast one by one, at most; more of them are broadcast as bits.
BROADCAST_GRAMS = 1_000_000
#: Blocks of 512 numbers of 64 bits that are broadcast, at most.
BIT_BLOCKS = 8_192


def lexicon_table(articles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A lexicon as a table; `position` gives the order of the types."""
    rows = [
        (entry.event_type, weight, keyword, position)
        for position, entry in enumerate(lexicon)
        for weight in ("high", "medium")
        for keyword in getattr(entry, weight)
    ]
    return articles.sparkSession.createDataFrame(rows, LEXICON)


def _grams(text: Column, length: int) -> Column:
    """Every run of `length` characters, overlapping ones too."""
    if length == 0:
        return F.array(F.lit(""))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def _all_grams(text: Column, lengths: list[int]) -> Column:
    return F.concat(*[_grams(text, n) for n in lengths])


def _bit_blocks(grams: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(_block, _bits) and the number of blocks: a bit for the hash of every gram, about eight for each row."""
    count = min(BIT_BLOCKS, 1 << max(0, (8 * rows // 32_768).bit_length()))
    block, number, bit = _bit_place(F.xxhash64("gram"), count)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    # Every number of every block is there, if only as zero.
    every = grams.sparkSession.range(512 * count)
    zeros = every.select(
        F.pmod("id", F.lit(count)).alias("_block"), F.floor(F.col("id") / count).cast("int").alias("_number"),
        F.lit(0).cast("long").alias("_bits"),
    )
    held = grams.select(block.alias("_block"), number.alias("_number"), one.alias("_bits"))
    numbers = held.unionByName(zeros).groupBy("_block", "_number").agg(F.bit_or("_bits").alias("_bits"))
    ordered = F.array_sort(F.collect_list(F.struct("_number", "_bits")))
    return numbers.groupBy("_block").agg(F.transform(ordered, lambda x: x["_bits"]).alias("_bits")), count


def _bit_place(hashed: Column, count: int) -> tuple[Column, Column, Column]:
    """Block, number in it and bit in the number of a hash."""
    number = F.shiftrightunsigned(hashed, 40).bitwiseAND(F.lit(511)).cast("int")
    bit = F.shiftrightunsigned(hashed, 52).bitwiseAND(F.lit(63)).cast("int")
    return F.pmod(hashed, F.lit(count).cast("long")), number, bit


def _among(held: DataFrame, grams: DataFrame, rows: int) -> DataFrame:
    """Rows of `held` (gram) whose gram may be one of the `rows` rows of `grams`, told before any shuffle.

    By hashes, or by bits of them: a gram that shares another's may stay, and the join by gram that follows decides.
    """
    hashed = F.xxhash64("gram")
    if rows <= BROADCAST_GRAMS:
        hashes = grams.select(hashed.alias("_hash")).distinct()
        return held.join(F.broadcast(hashes), hashed == F.col("_hash"), "left_semi")
    blocks, count = _bit_blocks(grams, rows)
    block, number, bit = _bit_place(hashed, count)
    met = (block == F.col("_block")) & (F.getbit(F.get("_bits", number), bit) == 1)
    return held.join(F.broadcast(blocks), met, "left_semi")


def _filed(texts: DataFrame, keywords: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """(keyword, gram): the gram of each keyword that `texts` (text) hold least often."""
    own = F.lit(None).cast("array<string>")
    for n in lengths:
        own = F.when(F.least(F.char_length("keyword"), F.lit(gram)) == n, _grams(F.col("keyword"), n)).otherwise(own)
    pairs, seen = materialize(
        keywords.select("keyword", F.explode(F.array_distinct(own)).alias("gram")), "keyword-grams"
    )
    # Only grams of keywords are counted, and their counts are shuffled.
    met = texts.select(F.explode(_all_grams(F.col("text"), lengths)).alias("gram"))
    often = _among(met, pairs, seen["rows"]).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # A keyword with a gram that no text holds occurs in none.
    return (
        pairs.join(often, "gram", "left")
        .groupBy("keyword")
        .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("least"))
        .where("least.often > 0")
        .select("keyword", "least.gram")
    )


def candidates(texts: DataFrame, lexicon: DataFrame, gram: int = GRAM) -> DataFrame:
    """(id, words): for texts (`id`, `text`) the lexicon's words whose filed gram they hold.

    A word is (keyword, high, medium, place, event_type); high and medium count its rows.
    """
    rows = lexicon.where(F.col("keyword").isNotNull())
    weight = F.col("weight_class")
    types = rows.groupBy("event_type").agg(F.min("position").alias("place"))
    counted = rows.groupBy("event_type", "keyword").agg(
        F.count_if(weight == "high").cast("int").alias("high"),
        F.count_if(weight == "medium").cast("int").alias("medium"),
    )
    same = counted["event_type"].eqNullSafe(types["event_type"])
    words, seen = materialize(
        counted.join(types, same).select("keyword", "high", "medium", "place", counted["event_type"]),
        "lexicon",
        F.collect_set(F.least(F.char_length("keyword"), F.lit(gram))).alias("lengths"),
    )
    faulty = rows.where(~F.coalesce(weight.isin("high", "medium"), F.lit(False))).limit(1)
    if faulty.count():
        raise ValueError("a weight class is neither high nor medium")
    lengths = sorted(seen["lengths"] or [])
    if not lengths:
        none = f"id {texts.schema['id'].dataType.simpleString()}, words array<{words.schema.simpleString()}>"
        return texts.sparkSession.createDataFrame([], none)
    filed = _filed(texts, words.select("keyword").distinct(), lengths, gram)
    index, stored = materialize(
        words.join(filed, "keyword").select("gram", F.struct(*words.columns).alias("word")),
        "keyword-index",
    )
    held = texts.select("id", F.explode(F.array_distinct(_all_grams(F.col("text"), lengths))).alias("gram"))
    # A broadcast by Spark's own size check, else a shuffle by gram.
    met = _among(held, index, stored["rows"]).join(index, "gram").select("id", "word")
    # Shuffled before they are collected, for rows that follow each other have the same word, which packs.
    return met.repartition("id").groupBy("id").agg(F.collect_set("word").alias("words"))


def table_hits(articles: DataFrame, lexicon: DataFrame, gram: int = GRAM) -> DataFrame:
    """Articles with `hits`, `total_high`, `total_medium` and `best`, as `lexicon_hits` gives them.

    `hits` has the types that occur only. Ids need not be unique: each row is judged on its own text.
    """
    text = scoring.score_text(F.col("headline"), F.col("summary"))
    # Ids travel as hashes: candidates are looked for in the text, so two ids may share one.
    found = candidates(articles.select(F.xxhash64("id").alias("id"), text.alias("text")), lexicon, gram)
    maybe = found.select(F.col("id").alias("_id"), F.col("words").alias("_maybe"))
    met = articles.withColumn("_id", F.xxhash64("id")).join(maybe, "_id", "left").drop("_id")
    held = F.filter(
        F.coalesce("_maybe", F.array().cast(maybe.schema["_maybe"].dataType)),
        lambda word: F.contains("_text", word["keyword"]),
    )
    # The text is made once, not once for each candidate.
    checked = settle(settle(met, text.alias("_text")), held.alias("_held")).drop("_maybe", "_text")
    kinds = F.array_distinct(
        F.transform("_held", lambda word: F.struct(word["place"], word["event_type"]))
    )

    def count(kind: Column, weight: str) -> Column:
        mine = F.filter("_held", lambda word: word["event_type"].eqNullSafe(kind["event_type"]))
        return F.aggregate(mine, F.lit(0), lambda acc, word: acc + word[weight])

    hits = F.transform(
        kinds,
        lambda kind: F.struct(
            count(kind, "high").alias("high"),
            count(kind, "medium").alias("medium"),
            (-kind["place"]).alias("rank"),
            kind["event_type"].alias("event_type"),
        ),
    )
    counted = settle(checked, hits.alias("hits")).drop("_held")
    none = F.struct(
        F.lit(0).alias("high"), F.lit(0).alias("medium"), F.lit(0).cast("long").alias("rank"),
        F.lit(None).cast("string").alias("event_type"),
    )
    return settle(
        counted,
        scoring.total(F.col("hits"), "high").alias("total_high"),
        scoring.total(F.col("hits"), "medium").alias("total_medium"),
        F.coalesce(scoring.best_hit(F.col("hits")), none).alias("best"),
    )
