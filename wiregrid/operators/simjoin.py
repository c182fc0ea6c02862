"""Exact set-similarity join on headline tokens (prefix filter over signatures).

Two token sets with Jaccard similarity t or more share their rarest common
token within a known prefix of each set (Chaudhuri et al., ICDE 2006; Bayardo
et al., WWW 2007; Vernica et al., SIGMOD 2010). A signature is the first token
two sets may share; where a token is frequent, signatures are the first two
they share, then three, so that signatures do not stay crowded.

The join of signatures carries no sets: an entry has numbers of fixed size, its
place in the set, which bounds what can be shared after it, and 640 bits in
which every token flips one (as the bitmap filter of Sandes et al., TKDE 2020):
sets differ in at least as many tokens as bits. Large sets, which fill those,
bring 1,920 bits more. Spark deals the entries out by signature; a task sorts
those of a signature by size and compares the pairs whose sizes agree, in array
operations, many of one signature in blocks (meetings.py). Sets are fetched once per distinct pair that is left,
and decide.

Sets are compared by 64-bit token hashes. Indexing counts the tokens that share
a hash: where there are none, which is all but certain, hashes are as good as
tokens; otherwise pairs are decided on the tokens themselves. Signatures that
share a hash bring pairs together that are decided like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wiregrid.functions.text import WORD, jaccard, word_set
from wiregrid.operators.meetings import met_in_part
from wiregrid.session import materialize

SEPARATOR = "\u0001"
#: Tokens that are broadcast with their frequency, at most; the frequency of others comes by a join.
FREQUENT_TOKENS_LIMIT = 50_000
_SLACK = 1e-9


@dataclass(frozen=True)
class Tuning:
    """Sizes that steer the work; none of them changes a result."""

    crowded: int = 32_768  # a signature of more sets is refined by one more token
    max_depth: int = 3  # tokens in a signature at most
    rows_per_salt: int = 20_000  # rows of a crowded signature per task
    # Candidate pairs allowed inside the first batch, and pairs of sets to compare inside a later one:
    pairs_min: int = 20_000_000  # at least,
    pairs_per_set: int = 64  # and per set
    batch_growth: int = 1_000  # candidate pairs of a batch by those of the one before, at most
    signature_rows_max: int = 65_536  # sets in one signature inside a batch
    heavy_rows_min: int = 50_000  # articles that make a key worth special care
    local_edges: int = 2_000_000  # pairs of one component that a task walks through
    entries_per_part: int = 200_000  # entries that a task compares at a time, about
    hash_bits: int = 64  # of token and signature hashes


@dataclass
class SetIndex:
    """Distinct token sets of a feed, their token hashes ordered from rare to frequent."""

    sets: DataFrame  # block, set_key, seq, copies
    ordered: DataFrame  # seq, block, n, marks, map0 .. map9, wide
    threshold: float
    rows: int  # distinct sets
    articles: int  # headlines in those sets
    tuning: Tuning
    crowded: list[DataFrame] = field(default_factory=list)  # per depth: sig, rows, refine
    entries: int = 0  # in all signatures, before any is refined
    pairs: float | None = None  # sets that meet in all signatures, where none is crowded
    closed: bool = False  # the deepest signatures found are not refined further
    faithful: bool = True  # no two tokens share a hash


def token_sets(articles: DataFrame, block: Column | None = None) -> DataFrame:
    """Articles grouped by equal token set: first `seq` and number of copies."""
    tokens = F.array_sort(word_set(F.col("headline")))
    worded = articles.where(F.col("headline").rlike(WORD))
    return (
        worded.select(
            (F.lit("") if block is None else block).alias("block"),
            F.array_join(tokens, SEPARATOR).alias("set_key"),
            "seq",
        )
        .groupBy("block", "set_key")
        .agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("copies"))
    )


def _hash(tuning: Tuning, *columns) -> Column:
    whole = F.xxhash64(*columns)
    if tuning.hash_bits >= 64:
        return whole
    return whole.bitwiseAND(F.lit((1 << tuning.hash_bits) - 1).cast("long"))


#: Columns of the bits that the tokens of a set flip.
_MAPS = [f"map{i}" for i in range(10)]


def _bit(mark: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), mark.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def _flipped(part: int) -> Column:
    """One of the ten parts of a set's bits; the upper half of a token's hash chooses the part."""
    mark = F.col("mark")
    here = F.shiftrightunsigned(mark, 32) % len(_MAPS) == part
    return F.bit_xor(F.when(here, _bit(mark)).otherwise(F.lit(0).cast("long"))).alias(f"map{part}")


#: Sets of more tokens than this also have wide bits, in as many parts of 64.
_LARGE, _WIDE = 100, 30


def _wide_bits() -> Column:
    """The bits that the tokens `marks` of a large set flip; null for others."""
    none = F.lit(0).cast("long")

    def part(place: Column) -> Column:
        here = F.filter("marks", lambda mark: F.shiftrightunsigned(mark, 32) % _WIDE == place)
        return F.aggregate(here, none, lambda bits, mark: bits.bitwiseXOR(_bit(mark)))

    return F.when(F.col("n") > _LARGE, F.transform(F.sequence(F.lit(0), F.lit(_WIDE - 1)), part))


def _with_frequency(marks: DataFrame, counted: DataFrame, floor: float) -> DataFrame:
    """`marks` with `df`, over how many sets hold their hash.

    Fewer than FREQUENT_TOKENS_LIMIT hashes are above the floor: those are broadcast. The others
    are not frequent, so none of them is a hot key of the join that finds theirs.
    """
    frequent = counted.where(F.col("df") > floor).select("mark", F.col("df").alias("_often"))
    rare = counted.where(F.col("df") <= floor).select(F.col("mark").alias("_mark"), "df")
    met = marks.join(F.broadcast(frequent), "mark", "left")
    # Rows that have theirs already go to partitions of their own choice.
    key = F.when(F.col("_often").isNull(), F.col("mark")).otherwise(F.xxhash64("seq", "mark"))
    met = met.withColumn("_key", key).join(rare, F.col("_key") == F.col("_mark"), "left")
    return met.select("seq", "block", "mark", F.coalesce("_often", "df").alias("df"))


def build_index(
    articles: DataFrame,
    threshold: float,
    block: Column | None = None,
    tuning: Tuning = Tuning(),
) -> SetIndex:
    """Prepare a feed (`seq`, `headline`) for a similarity join at 0 < threshold <= 1.

    Sets of different `block` are never compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    sets, seen = materialize(
        token_sets(articles, block),
        "sets",
        F.sum(F.size(F.split("set_key", SEPARATOR))).alias("tokens"),
        F.sum("copies").alias("articles"),
    )
    tokens = sets.select("seq", "block", F.explode(F.split("set_key", SEPARATOR)).alias("token"))
    marks = tokens.withColumn("mark", _hash(tuning, "token"))
    shared = Observation()
    counted, _ = materialize(
        marks.groupBy("mark")
        .agg(F.count(F.lit(1)).alias("df"), F.min("token").alias("_min"), F.max("token").alias("_max"))
        .observe(shared, F.count_if(F.col("_min") != F.col("_max")).alias("hashes"))
        .select("mark", "df"),
        "token-counts",
    )
    floor = (seen["tokens"] or 0) / FREQUENT_TOKENS_LIMIT
    by_rarity = F.array_sort(F.collect_list(F.struct("df", "mark")))
    ordered, _ = materialize(
        _with_frequency(marks.drop("token"), counted, floor)
        .groupBy("seq", "block")
        .agg(by_rarity.alias("_pairs"), *[_flipped(i) for i in range(len(_MAPS))])
        .select(
            "seq",
            "block",
            F.size("_pairs").alias("n"),
            F.transform("_pairs", lambda pair: pair["mark"]).alias("marks"),
            *_MAPS,
        )
        .withColumn("wide", _wide_bits()),
        "ordered",
    )
    index = SetIndex(
        sets, ordered, threshold, seen["rows"], seen["articles"] or 0, tuning
    )
    index.faithful = not shared.get["hashes"]
    while not index.closed:
        table, found, pairs, entries = _find_crowded(index)
        index.entries = index.entries or entries
        if not found["rows"]:
            index.pairs = pairs if not index.crowded else None
            break
        index.crowded.append(table)
        index.closed = not found["refined"] or len(index.crowded) == tuning.max_depth
    return index


def _least_overlap(threshold: float) -> Column:
    """Fewest tokens a set of `n` shares with any similar set."""
    return F.ceil(threshold * F.col("n") - _SLACK).cast("int")


#: What an entry has besides its signature: all of fixed size, `wide` for large sets only.
_ENTRY = ["seq", "n", *_MAPS, "wide"]


def _first_level(index: SetIndex, sets: DataFrame) -> DataFrame:
    prefix = F.col("n") - F.greatest(_least_overlap(index.threshold), F.lit(1)) + 1
    return sets.select(
        "block", *_ENTRY, F.posexplode(F.slice("marks", F.lit(1), prefix)).alias("_at", "_mark")
    ).select(
        *_ENTRY,
        _hash(index.tuning, "block", "_mark").alias("sig"),
        (F.col("_at") + 1).alias("pos"),
    )


def _reach(index: SetIndex, depth: int) -> Column:
    """The last place of the next token of a signature of `depth` tokens."""
    return F.col("n") - F.greatest(_least_overlap(index.threshold), F.lit(depth + 1)) + depth + 1


def _refine(index: SetIndex, entries: DataFrame, depth: int) -> DataFrame:
    """Signatures of `depth + 1` tokens from those of `depth`; a set's tokens are fetched once."""
    held = entries.groupBy("seq").agg(F.collect_list(F.struct("sig", "pos")).alias("_held"))
    opened = index.ordered.join(held, "seq").select(
        *_ENTRY, "marks", F.inline("_held")
    )
    following = F.slice(
        "marks", F.col("pos") + 1, F.greatest(_reach(index, depth) - F.col("pos"), F.lit(0))
    )
    return opened.select(*_ENTRY, "sig", "pos", F.posexplode(following).alias("_at", "_mark")).select(
        *_ENTRY,
        _hash(index.tuning, "sig", "_mark").alias("sig"),
        (F.col("pos") + F.col("_at") + 1).alias("pos"),
    )


def _find_crowded(index: SetIndex) -> tuple[DataFrame, dict, float, int]:
    """Signatures at the next depth that too many sets hold.

    Also how many they are and how many of them are refined, and the pairs of sets that meet in all
    signatures and the entries of these. One is refined where that makes fewer entries than the pairs it would bring together.
    """
    level = _first_level(index, index.ordered)
    for depth, table in enumerate(index.crowded, start=1):
        refined = table.where("refine")
        level = _refine(index, level.join(refined, "sig", "left_semi"), depth)
    depth = len(index.crowded) + 1
    more = F.greatest(_reach(index, depth) - F.col("pos"), F.lit(0)).cast("long")
    counted = level.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.sum(more).alias("_more"))
    seen = Observation()
    rows = F.col("rows").cast("double")
    pairs = rows * (rows - 1) / 2
    table, found = materialize(
        counted.observe(seen, F.sum(pairs).alias("pairs"), F.sum("rows").alias("entries"))
        .where(F.col("rows") > index.tuning.crowded)
        .select("sig", "rows", (pairs > F.col("_more")).alias("refine")),
        f"crowded{depth}",
        F.count_if(F.col("refine")).alias("refined"),
    )
    return table, found, seen.get["pairs"] or 0.0, seen.get["entries"] or 0


def signatures(index: SetIndex, sets: DataFrame, wide: bool = False) -> DataFrame:
    """Final signatures of `sets` (rows of index.ordered), with the wide bits of large sets if asked for.

    Columns: seq, n, map0 .. map9, sig, depth, pos (of the last signature token), own and want
    (sizes, for pairs that share nothing but the signature; else 0) and fan (over how many tasks a
    crowded signature is spread). Similar sets meet at their first common tokens.
    """
    final = _final_signatures(index, sets)
    return final if wide else final.drop("wide")


def _final_signatures(index: SetIndex, sets: DataFrame) -> DataFrame:
    none, salt = F.lit(0), index.tuning.rows_per_salt
    level = _first_level(index, sets)
    done = []
    for depth, table in enumerate(index.crowded, start=1):
        marked = level.join(table, "sig", "left")
        if index.closed and depth == len(index.crowded):
            done.append(_final(marked, depth, none, none, salt))
            return _union(done)
        refine = F.coalesce("refine", F.lit(False))
        done.append(_final(marked.where(~refine), depth, none, none, salt))
        full = marked.where(refine)
        done.append(_exact_overlap(index, full, depth))
        level = _refine(index, full, depth)
    rest = level.withColumn("rows", F.lit(None).cast("long"))
    done.append(_final(rest, len(index.crowded) + 1, none, none, salt))
    return _union(done)


def _exact_overlap(index: SetIndex, crowded: DataFrame, depth: int) -> DataFrame:
    """Entries for pairs whose whole overlap is a crowded signature of `depth` tokens.

    Such pairs are similar exactly if their sizes sum to depth * (1 + t) / t
    or less, so each set names the partner sizes it accepts.
    """
    t = index.threshold
    most = F.floor(F.lit(depth * (1 + t) / t + _SLACK)) - F.col("n")
    sizes = F.when(most >= depth, F.sequence(F.lit(depth).cast("long"), most)).otherwise(
        F.array().cast("array<bigint>")
    )
    wanted = crowded.withColumn("_want", F.explode(sizes))
    return _final(wanted, depth, F.col("n"), F.col("_want").cast("int"), index.tuning.rows_per_salt)


def _final(entries: DataFrame, depth: int, own: Column, want: Column, salt: int) -> DataFrame:
    return entries.select(
        *_ENTRY,
        "sig",
        F.lit(depth).alias("depth"),
        "pos",
        own.alias("own"),
        want.alias("want"),
        F.ceil(F.coalesce(F.col("rows"), F.lit(1)) / salt).cast("int").alias("fan"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def similar_pairs(
    index: SetIndex, low: DataFrame, high: DataFrame, salted: bool = False
) -> DataFrame:
    """Distinct pairs (lo, hi) of `seq` with lo < hi and similarity >= threshold.

    `low` and `high` are signatures of the two sides. With `salted`, rows of a crowded signature
    on the high side are spread over tasks and the low side is copied to each of them.
    """
    if salted:
        low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
        high = high.withColumn("salt", F.pmod(F.xxhash64("seq"), F.col("fan")).cast("int"))
    else:
        low, high = low.withColumn("salt", F.lit(0)), high.withColumn("salt", F.lit(0))
    sides = low.withColumn("side", F.lit(0)).unionByName(high.withColumn("side", F.lit(1)))
    return _decided(index, _met(index, sides).distinct())


def pairs_inside(index: SetIndex, entries: DataFrame) -> tuple[DataFrame, int]:
    """The pairs of `similar_pairs` among the sets of `entries`, and how many sets were compared.

    The pairs that sizes, places and bits leave are stored, then compared.
    """
    inside = entries.withColumn("salt", F.lit(0)).withColumn("side", F.lit(None).cast("int"))
    left, seen = materialize(_met(index, inside).distinct(), "met")
    return _decided(index, left), seen["rows"]


def _met(index: SetIndex, entries: DataFrame) -> DataFrame:
    """Pairs (lo, hi) of entries that share a signature and may be similar by sizes, places and bits.

    Entries of side 0 meet those of side 1 that come later; those without a side all others. A set
    shares 2t / (1 + t) of its tokens with a similar one that is no smaller, so as the smaller one
    only an entry early enough for that meets another.
    """
    t = index.threshold
    early = F.col("depth") + F.col("n") - F.col("pos") >= 2 * t / (1 + t) * F.col("n") - _SLACK
    if "wide" not in entries.columns:
        entries = entries.withColumn("wide", F.lit(None).cast("array<bigint>"))
    # What shares this hash by chance brings pairs together that are decided like any other.
    key = F.xxhash64("sig", "depth", F.least("own", "want"), F.greatest("own", "want"), "salt")
    parts = max(1, -(-index.entries // index.tuning.entries_per_part))
    # What has no place in the feed comes before nothing.
    dealt = entries.where(F.col("seq").isNotNull()).select(
        key.alias("key"), *_ENTRY, "depth", "pos", "own", "want", "side", early.alias("early")
    ).withColumn("_part", F.pmod("key", F.lit(parts)))
    return dealt.groupBy("_part").applyInArrow(
        lambda table: met_in_part(table, t, _SLACK, _MAPS, _WIDE), "lo long, hi long"
    )


def _decided(index: SetIndex, pairs: DataFrame) -> DataFrame:
    """The pairs that are similar, by their sets: of hashes, or of tokens where hashes are shared."""
    if index.faithful:
        side = index.ordered.select("seq", "block", F.col("marks").alias("tokens"))
        similarity = jaccard(F.col("lo_tokens"), F.col("hi_tokens"))
    else:
        side = index.sets.select("seq", "block", F.col("set_key").alias("tokens"))
        similarity = jaccard(F.split("lo_tokens", SEPARATOR), F.split("hi_tokens", SEPARATOR))
    lo = side.select([F.col(c).alias(f"lo_{c}") for c in side.columns])
    hi = side.select([F.col(c).alias(f"hi_{c}") for c in side.columns])
    # The comparison belongs to the join: a filter after it would compute it twice.
    return (
        pairs.join(lo, F.col("lo") == F.col("lo_seq"))
        .join(
            hi,
            (F.col("hi") == F.col("hi_seq"))
            & (F.col("lo_block") == F.col("hi_block"))
            & (similarity >= index.threshold),
        )
        .select("lo", "hi")
    )
