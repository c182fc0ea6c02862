"""First-match leader clustering over a similarity join, in parallel.

Going through a feed in order, an article joins the first leader similar to
it, or becomes a leader. So an article leads exactly if no similar article
before it leads: the leaders are the lexicographically first maximal
independent set of the similarity graph. Components of it are independent and
walked through in parallel; one too large for that is settled in parallel rounds
(Blelloch, Fineman, Shun, SPAA 2012).

The feed is taken in batches from the front. Once the leaders of a batch are
known, every later set similar to one of them is settled and leaves. The first
batch is cut so that the pairs met inside it stay within a bound; a large group
of near copies therefore meets its own leader, not itself. What share of those
pairs had to be compared tells how many may meet in the next batch. Where few
have to be there are few batches, whatever the number of articles: a further one
saves nothing but takes all later sets through the join once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiregrid.operators.graph import leaders
from wiregrid.operators.simjoin import SetIndex, Tuning, pairs_inside, signatures, similar_pairs
from wiregrid.session import materialize

_HALVINGS = 16


def assign_leaders(index: SetIndex) -> DataFrame:
    """(seq, leader) for every set of the index that follows another set's lead.

    Sets missing from the result lead themselves.
    """
    remaining, rows, tuning = index.ordered, index.rows, index.tuning
    fits = index.pairs is not None and tuning.crowded <= tuning.signature_rows_max
    settled: list[DataFrame] = []
    budget = max(tuning.pairs_min, tuning.pairs_per_set * rows)
    while rows:
        entries = signatures(index, remaining, wide=True)
        if fits and index.pairs <= budget:
            cut = None
        else:
            cut, meetings = _batch_end(entries, remaining, budget, tuning.signature_rows_max)
        inside = entries if cut is None else entries.where(F.col("seq") <= cut)
        pairs, left = pairs_inside(index, inside)
        pairs, seen = materialize(pairs, "pairs")
        followed = None
        if seen["rows"]:
            followed, _ = materialize(leaders(pairs, seen["rows"], tuning.local_edges), "followed")
            settled.append(followed)
        if cut is None:
            break
        leading = remaining.where(F.col("seq") <= cut)
        if followed is not None:
            leading = leading.join(followed, leading.seq == followed.hi, "left_anti")
        later = remaining.where(F.col("seq") > cut)
        met = similar_pairs(
            index,
            signatures(index, leading, wide=True),
            signatures(index, later, wide=True),
            salted=True,
        )
        # The batch comes first in the feed, so its lowest leader is the first match.
        absorbed, _ = materialize(met.groupBy("hi").agg(F.min("lo").alias("leader")), "absorbed")
        settled.append(absorbed)
        remaining, seen = materialize(
            later.join(absorbed, later.seq == absorbed.hi, "left_anti"), "remaining"
        )
        rows = seen["rows"]
        budget = _next_budget(tuning, rows, meetings, left)
    spark = index.ordered.sparkSession
    result = spark.createDataFrame([], "seq long, leader long")
    for part in settled:
        result = result.unionByName(part.withColumnRenamed("hi", "seq"))
    return result


def _next_budget(tuning: Tuning, rows: int, meetings: float, left: int) -> float:
    """Candidate pairs of the next batch: as many as should leave no more to compare than is allowed."""
    allowed = max(tuning.pairs_min, tuning.pairs_per_set * rows)
    return max(allowed, meetings * min(allowed / max(left, 1), tuning.batch_growth))


def _batch_end(
    entries: DataFrame, remaining: DataFrame, budget: float, crowd: int
) -> tuple[int | None, float]:
    """Last `seq` of the next batch, or None when all the rest fits in one; the pairs that meet in it."""
    rows = F.col("_rows").cast("double")
    keys = ["sig", "own", "want"]
    whole = (
        entries.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .agg(F.sum(rows * (rows - 1) / 2).alias("pairs"), F.max("_rows").alias("most"))
        .first()
    )
    if (whole["pairs"] or 0) <= budget and (whole["most"] or 0) <= crowd:
        return None, whole["pairs"] or 0.0
    while True:
        best, over, pairs = _cut_within(entries, remaining, budget, crowd)
        if best is not None:
            return best, pairs
        # Even the first cut takes too much: look closer at what is before it.
        entries = entries.where(F.col("seq") <= over)
        remaining = remaining.where(F.col("seq") <= over)


def _cut_within(
    entries: DataFrame, remaining: DataFrame, budget: float, crowd: int
) -> tuple[int | None, int, float]:
    """(the last of some cuts that stays within the bounds, the first cut, the pairs before the last).

    A single set always does.
    """
    keys = ["sig", "own", "want"]
    rows = F.col("_rows").cast("double")
    shares = [0.5**i for i in range(_HALVINGS, 0, -1)]
    quantiles = remaining.agg(F.percentile_approx("seq", shares, 100_000).alias("q")).first()["q"]
    cuts = sorted(set(quantiles))
    # The smallest cut a row falls under, as its place among the few cuts.
    place = F.size(F.filter(F.array(*[F.lit(cut) for cut in cuts]), lambda cut: cut < F.col("seq")))
    so_far = Window.partitionBy(*keys).orderBy("place")
    costs = (
        entries.select(*keys, place.alias("place"))
        .where(F.col("place") < len(cuts))
        .groupBy(*keys, "place")
        .agg(F.count(F.lit(1)).alias("_new"))
        .withColumn("_rows", F.sum("_new").over(so_far))
        .withColumn("_added", rows * (rows - 1) / 2 - (rows - F.col("_new")) * (rows - F.col("_new") - 1) / 2)
        .groupBy("place")
        .agg(F.sum("_added").alias("pairs"), F.max("_rows").alias("most"))
        .orderBy("place")
        .collect()
    )
    best, pairs, within = None, 0.0, 0.0
    for row in costs:
        pairs += row["pairs"]
        if pairs > budget or row["most"] > crowd:
            break
        best, within = cuts[row["place"]], pairs
    if best is None:
        first = remaining.agg(F.min("seq")).first()[0]
        best = first if cuts[0] <= first else None
    return best, cuts[0], within
