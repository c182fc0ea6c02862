"""Graphs of similar pairs: connected components, and leaders in feed order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrid.session import materialize

_LED = "hi long, leader long"


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over `pairs` (lo, hi), for all nodes in them.

    In each round every root takes over the least root that any of its nodes sees, and then that
    one's own; so the number of rounds follows the logarithm of the longest path. Minima are
    combined before each shuffle.
    """
    both = pairs.select("lo", "hi").unionByName(
        pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))
    )
    state, _ = materialize(
        both.groupBy(F.col("lo").alias("node")).agg(F.least(F.min("hi"), F.min("lo")).alias("root")),
        "roots",
    )
    while True:
        seen = both.join(state.select(F.col("node").alias("hi"), F.col("root").alias("seen")), "hi")
        least = seen.groupBy(F.col("lo").alias("node")).agg(F.min("seen").alias("seen"))
        moves, found = materialize(
            state.join(least, "node")
            .groupBy("root")
            .agg(F.least(F.min("seen"), F.col("root")).alias("over")),
            "moves",
            F.count_if(F.col("over") < F.col("root")).alias("moved"),
        )
        if not found["moved"]:
            return state
        above = moves.select(F.col("root").alias("over"), F.col("over").alias("top"))
        tops = moves.join(above, "over", "left").select("root", F.coalesce("top", "over").alias("top"))
        state, _ = materialize(
            state.join(tops, "root").select("node", F.col("top").alias("root")), "roots"
        )


def _walk(lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], list[int]]:
    """(hi, leader) of the nodes that follow, going through the feed."""
    order = np.lexsort((lo, hi))
    followers: set[int] = set()
    nodes, leaders = [], []
    done = None
    for low, high in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
        # The first leader among a node's earlier neighbours is its own.
        if high != done and low not in followers:
            followers.add(high)
            nodes.append(high)
            leaders.append(low)
            done = high
    return nodes, leaders


def _walk_group(table: pa.Table) -> pa.Table:
    lo, hi = (table.column(c).to_numpy() for c in ("lo", "hi"))
    nodes, leaders = _walk(lo, hi)
    return pa.table({"hi": pa.array(nodes, pa.int64()), "leader": pa.array(leaders, pa.int64())})


def leaders(pairs: DataFrame, rows: int, local_edges: int) -> DataFrame:
    """(hi, leader) of every node that has a leader before it; the others of `pairs` (lo, hi) lead.

    A node leads if none of its earlier neighbours leads, else it follows the first that does.
    Components of up to `local_edges` pairs are walked through in one task each, many small ones
    together; larger ones are settled in rounds. `pairs` is a stored table of `rows` rows.
    """
    if rows <= local_edges:
        return _walked(pairs.withColumn("_part", F.lit(0)))
    root = components(pairs).select(F.col("node").alias("lo"), "root")
    placed, _ = materialize(pairs.join(root, "lo"), "placed")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("_pairs"))
    large, found = materialize(sizes.where(F.col("_pairs") > local_edges), "large")
    parts = -(-rows // local_edges)
    small = placed.join(large.select("root"), "root", "left_anti")
    walked, _ = materialize(
        _walked(small.select("lo", "hi", F.pmod(F.xxhash64("root"), F.lit(parts)).alias("_part"))),
        "walked",
    )
    if not found["rows"]:
        return walked
    rest, _ = materialize(placed.join(large.select("root"), "root", "left_semi").select("lo", "hi"), "rest")
    return walked.unionByName(_in_rounds(rest))


def _walked(parted: DataFrame) -> DataFrame:
    return parted.groupBy("_part").applyInArrow(
        lambda table: _walk_group(table.select(["lo", "hi"])), _LED
    )


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """Rounds of: a node nothing open precedes leads, what it precedes follows."""
    found: list[DataFrame] = []
    open_pairs = pairs
    while True:
        waiting = open_pairs.select(F.col("hi").alias("node")).distinct()
        led = open_pairs.join(waiting, open_pairs.lo == waiting.node, "left_anti")
        new, _ = materialize(led.select(F.col("hi").alias("node")).distinct(), "followers")
        found.append(new)
        rest = open_pairs.join(new, open_pairs.lo == new.node, "left_anti")
        open_pairs, seen = materialize(
            rest.join(new, rest.hi == new.node, "left_anti"), "open"
        )
        if not seen["rows"]:
            break
    followers = found[0]
    for part in found[1:]:
        followers = followers.unionByName(part)
    led = pairs.join(followers, pairs.lo == followers.node, "left_anti")
    return led.groupBy("hi").agg(F.min("lo").alias("leader"))
