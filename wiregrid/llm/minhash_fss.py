"""Near duplicates by fast similarity sketching, banding and verification.

A document's set holds its distinct k-word shingles. Its sketch is filled in
rounds: in round i < t every shingle falls into one of t bins by a hash of its
own, in round t + j all fall into bin j, and a bin keeps its least value, where
values of earlier rounds are less. Filling stops with the round after which no
bin is empty, so every coordinate is filled after 2t rounds at most, and most
sets need two or three. The share of equal coordinates of two sketches is
concentrated about the similarity of the sets.

Bands of coordinates are buckets. A pair at the threshold of 0.8 misses all 60
bands of 6 with a chance of 1.2e-8, one at 0.2 meets in one with 0.4 %. Documents with equal sets form a class and
appear once. In a bucket, members are not paired with each other but with a
few pivots, and of these pairs only those go on whose sketches are not too
unlike for the threshold; links are confirmed on the full sets, components are formed, and
only buckets that still hold more than one component go on with more pivots,
four times as many each round, until every pair of different components of a
bucket has been compared. So no cap is set and no candidate is lost.

In a large group of near copies many are just too unlike for the threshold, and
pivots would compare each of them with all others. So after the first round the
members of crowded buckets are met by their rarest shingles (prefix filter, as
in operators/simjoin.py): two sets that are alike share one of them, and what is rare in a copy
is what was changed in it. A member for which that brings fewer meetings than
its bucket has rows is compared with those it meets and leaves its crowded
buckets; the others go on with pivots.

Defined results: texts without words and null texts have no shingles and are
linked with nothing. Rows that share a doc_id are one member of the
graph, with the links of all of them; a null doc_id is never linked. Further columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wiregrid.llm.common import Words, batches_of, components, mix, rows_told, stored
from wiregrid.session import materialize


@dataclass(frozen=True)
class Near:
    """Shingle width in words, similarity in percent, bands and coordinates per band."""

    width: int = 5
    percent: int = 80
    bands: int = 60
    rows: int = 6
    crowd: int = 32  # open members that make a bucket crowded; no result depends on it


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    words = Words(texts, lower=True)
    n = len(words.hash)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = mix(rolled + words.hash[k : k + len(rolled)] + np.uint64(k + 1))
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(b - a):
                whole = mix(whole + words.hash[a + k] + np.uint64((b - a) << 32 | k + 1))
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates per set; an empty set has none of them filled (all ones)."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full((len(sets), t), none, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    live = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    flat = bins.reshape(-1)
    for i in range(2 * t):
        if not len(items):
            break
        drawn = mix(items + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        value = (drawn >> np.uint64(16)) | np.uint64(i << 48)
        place = (drawn & np.uint64(0xFFFF)) * np.uint64(t) >> np.uint64(16) if i < t else i - t
        np.minimum.at(flat, live * t + np.asarray(place).astype(np.int64), value)
        open_rows = (bins == none).any(axis=1)
        going = open_rows[live]
        live, items = live[going], items[going]
    return bins


def band_keys(bins: np.ndarray, near: Near) -> np.ndarray:
    """One 64-bit bucket key per set and band."""
    folded = bins.reshape(len(bins), near.bands, near.rows)
    keys = np.broadcast_to(np.arange(near.bands, dtype=np.uint64), folded.shape[:2]).copy()
    for k in range(near.rows):
        keys = mix(keys + folded[:, :, k])
    return keys


def sketch_bits(bins: np.ndarray) -> np.ndarray:
    """One bit of every coordinate, 64 to a number: they differ in half of unequal coordinates."""
    bits = np.zeros((len(bins), -(-bins.shape[1] // 64) * 64), np.uint8)
    bits[:, : bins.shape[1]] = bins & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64)


def _unlike(near: Near) -> int:
    """More differing bits than this has a pair at the threshold with a chance below 1e-9.

    The number is concentrated about (1 - similarity) / 2 per coordinate.
    """
    n, p = near.bands * near.rows, (100 - near.percent) / 200
    return math.ceil(n * p + 6.5 * math.sqrt(n * p * (1 - p)) + 1)


def signatures(docs: DataFrame, near: Near, column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, bands, bits) of every row of `docs`."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, texts in batches_of(rows, column):
            sets = shingle_sets(texts, near.width)
            bins = sketch(sets, near.bands * near.rows)
            lists = []
            for values in (band_keys(bins, near).view(np.int64), sketch_bits(bins)):
                ends = np.arange(len(sets) + 1, dtype=np.int32) * values.shape[1]
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        pa.binary(),
                    ),
                    *lists,
                ],
                names=["doc_id", "n_shingles", "digest", "bands", "bits"],
            )

    return docs.select("doc_id", column).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"
    )


def full_sets(docs: DataFrame, near: Near, column: str = "text") -> DataFrame:
    """(cid, members) with the whole shingle set of every row of `docs`."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, texts in batches_of(rows, column):
            sets = shingle_sets(texts, near.width)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64))),
                ],
                names=["cid", "members"],
            )

    return docs.select("doc_id", column).mapInArrow(run, "cid long, members array<long>")


def _alike(percent: int, shared: Column, a: Column, b: Column) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are alike."""
    left = sets.select(F.col("cid").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("members").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(_alike(near.percent, shared, F.size("of_a"), F.size("of_b")))
        .select("a", "b")
    )


#: Shingles that are broadcast with their frequency, at most.
_FREQUENT = 50_000


def _rarest(members: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """(cid, n, comp, mark, pos): the shingles of `members` (cid, n, comp) that one alike must share, from rare to frequent."""
    marks = sets.join(members.select("cid"), "cid").select("cid", F.explode("members").alias("mark"))
    counted, seen = materialize(
        marks.groupBy("mark").agg(F.count(F.lit(1)).alias("df")), "near-marks", F.sum("df").alias("all")
    )
    floor = (seen["all"] or 0) / _FREQUENT
    often = counted.where(F.col("df") > floor).select("mark", F.col("df").alias("_often"))
    rare = rows_told(counted, seen)[0].where(F.col("df") <= floor).select(F.col("mark").alias("_mark"), "df")
    met = marks.join(F.broadcast(often), "mark", "left")
    # Rows that have their frequency already go to partitions of their own choice.
    key = F.when(F.col("_often").isNull(), F.col("mark")).otherwise(F.xxhash64("cid", "mark"))
    met = met.withColumn("_key", key).join(rare, F.col("_key") == F.col("_mark"), "left")
    ordered = met.groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("_often", "df").alias("df"), "mark"))).alias("_held")
    )
    n, percent = F.col("n"), near.percent
    least = F.ceil(percent * (n + F.ceil(percent * n / 100)) / (100 + percent))
    first = F.slice("_held", F.lit(1), (n - least + 1).cast("int"))
    return ordered.join(members, "cid").select(
        "cid", "n", "comp", F.posexplode(F.transform(first, lambda held: held["mark"])).alias("pos", "mark")
    )


def _size_class(n: Column) -> Column:
    return F.floor(16 * F.log2(n.cast("double"))).cast("int")


def _by_rarest(rest: DataFrame, sets: DataFrame, near: Near) -> tuple[DataFrame, DataFrame] | None:
    """(links, told) of the crowded buckets among `rest`; None where no member is told.

    `told` (key, cid) has the rows of members that were compared with all of the other components
    in all crowded buckets.
    """
    rows = rest.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > near.crowd)
    crowded, seen = rows_told(*materialize(rest.join(rows, "key").select("key", "cid", "n", "comp", "_rows"), "near-crowded"))
    if not seen["rows"]:
        return None
    members, _ = rows_told(*materialize(
        crowded.groupBy("cid", "n", "comp").agg(F.max("_rows").alias("_most")), "near-members"
    ))
    first, _ = rows_told(*materialize(_rarest(members.drop("_most"), sets, near), "near-rarest"))
    index = first.select(
        "mark", _size_class(F.col("n")).alias("size"), F.col("cid").alias("other"),
        F.col("comp").alias("own"), F.col("n").alias("m"), F.col("pos").alias("at"),
    )
    # A shingle with so many rarer ones before it is the first that is shared with sets up to a size only.
    n, percent = F.col("n"), near.percent
    largest = F.floor((100 + percent) * (n - F.col("pos")) / percent) - n
    sizes = F.sequence(_size_class(F.ceil(percent * n / 100)), _size_class(largest))
    probes = first.select("*", F.explode(sizes).alias("size"))
    counts = index.groupBy("mark", "size").agg(F.count(F.lit(1)).alias("_held"))
    itself = F.when(F.col("size") == _size_class(n), 1).otherwise(0)
    costs = (
        probes.join(counts, ["mark", "size"])
        .groupBy("cid")
        .agg(F.sum(F.col("_held") - itself).alias("_cost"))
    )
    told, seen = rows_told(*materialize(
        members.join(costs, "cid").where(F.col("_cost") <= F.col("_most")).select("cid"), "near-told"
    ))
    if not seen["rows"]:
        return None
    shared = F.least(n - F.col("pos"), F.col("m") - F.col("at"))
    met = probes.join(told, "cid").join(index, ["mark", "size"]).where(
        (F.col("comp") != F.col("own")) & ((100 + percent) * shared >= percent * (n + F.col("m")))
    )
    pairs, _ = rows_told(*materialize(
        met.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct(),
        "near-pairs",
    ))
    links, _ = rows_told(*materialize(_confirmed(pairs, sets, near), "near-links"))
    return links, crowded.join(told, "cid").select("key", "cid")


def _still_open(rest: DataFrame, roots: DataFrame, bits: list[str]) -> tuple[DataFrame, dict]:
    """Rows of the buckets that hold more than one component of `roots`, with the size of theirs."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    now = roots.join(sizes, "root").withColumnRenamed("node", "cid")
    left = rest.join(now, "cid", "left").select(
        "key", "cid", "n", *bits, F.coalesce("root", "cid").alias("comp"),
        F.coalesce("size", F.lit(1).cast("long")).alias("weight"),
    )
    left, _ = rows_told(*materialize(left, "near-left"))
    mixed = left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    # What earlier rounds have left on the driver and on disk can go.
    return rows_told(*stored(left.join(mixed.where("x <> y").select("key"), "key"), "near-open"))


def _bucket_roots(buckets: DataFrame, sets: DataFrame, links: DataFrame, near: Near) -> DataFrame:
    """Components (node, root) of `links` and all that is linked inside the buckets (key, cid, n, bits).

    A pivot that was compared with all other components of its bucket leaves
    it, and so does a member told by its rarest shingles. Members of small
    components are pivots first. Components are formed anew only when a round
    has found links.
    """
    bits = [c for c in buckets.columns if c not in ("key", "cid", "n")]
    rest, roots, tried, count = buckets.select(
        "*", F.col("cid").alias("comp"), F.lit(1).cast("long").alias("weight")
    ), None, None, 1
    n_tried = 0
    while True:
        first = Window.partitionBy("key").orderBy("weight", "cid")
        pivots, _ = rows_told(*materialize(
            rest.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= count)
            .select("key", F.col("cid").alias("pivot"), F.col("comp").alias("own"),
                    F.col("n").alias("m"), *[F.col(c).alias(f"p{c}") for c in bits]),
            "near-pivots",
        ))
        met = rest.join(pivots, "key").where(
            (F.col("comp") != F.col("own"))
            & _alike(near.percent, F.least("n", "m"), F.col("n"), F.col("m"))
            & (sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"p{c}"))) for c in bits) <= _unlike(near))
        )
        pairs = met.select(
            F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")
        ).distinct()
        if tried is not None:
            pairs = pairs.join(rows_told(tried, {"rows": n_tried})[0], ["a", "b"], "left_anti")
        pairs, new = rows_told(*materialize(pairs, "near-pairs"))
        n_tried += new["rows"]
        tried = pairs if tried is None else tried.unionByName(pairs)
        found, new = rows_told(*materialize(_confirmed(pairs, sets, near), "near-links"))
        if new["rows"] or roots is None:
            links = links.unionByName(found)
            roots = components(links, "near")
        left = rest.select("key", "cid", "n", *bits).join(
            pivots.withColumnRenamed("pivot", "cid"), ["key", "cid"], "left_anti"
        )
        rest, seen = _still_open(left, roots, bits)
        if not seen["rows"]:
            return roots
        told = _by_rarest(rest, sets, near) if count == 1 else None
        if told is not None:
            links = links.unionByName(told[0])
            roots = components(links, "near")
            left = rest.select("key", "cid", "n", *bits).join(told[1], ["key", "cid"], "left_anti")
            rest, seen = _still_open(left, roots, bits)
            if not seen["rows"]:
                return roots
        count *= 4


def near_components(docs: DataFrame, near: Near = Near(), column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text)."""
    signed, _ = materialize(signatures(docs, near, column), "near-signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes, _ = rows_told(*materialize(
        usable.groupBy("digest").agg(F.min("doc_id").alias("cid")), "near-classes"
    ))
    members = usable.join(classes, "digest")
    links = members.where("doc_id <> cid").select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
    keyed = members.where("doc_id = cid").select(
        F.explode("bands").alias("key"), "cid", F.col("n_shingles").alias("n")
    )
    shared = keyed.groupBy("key").agg(F.min("cid").alias("x"), F.max("cid").alias("y"))
    shared = shared.where("x <> y").select("key")
    parts = -(-near.bands * near.rows // 64)
    bits = members.where("doc_id = cid").select(
        "cid", *[F.col("bits")[k].alias(f"b{k}") for k in range(parts)]
    )
    buckets, seen = stored(
        keyed.join(shared, "key").join(bits.distinct(), "cid"), "near-buckets"
    )
    if not seen["rows"]:
        roots = components(links, "near")
    else:
        wanted = buckets.select(F.col("cid").alias("doc_id")).distinct()
        chosen = docs.select("doc_id", column).join(wanted, "doc_id", "left_semi")
        sets, _ = stored(full_sets(chosen, near, column), "near-sets")
        roots = _bucket_roots(rows_told(buckets, seen)[0], sets, links, near)
    return signed.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id"))
        .otherwise(F.col("doc_id"))
        .alias("component_id"),
    )
