"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Documents with equal texts form a group that is not divided. A partial
partition is a list of shard sums. The two partial partitions with the largest
spread are combined in opposite order, the largest sum of one with the smallest
of the other, until one is left. Groups are dealt into buckets of bounded size,
each bucket is differenced in a task, and the buckets' partial partitions are
differenced again in the same way, some at a time, until one is left.

Places inside a shard are counted in blocks of bounded size, with prefix sums
over the blocks, so no shard is sorted as a whole.

Defined results: null and empty texts are equal and weigh 16. Rows that share a
doc_id, or have none, are rows of their own. A group heavier than a shard's fair
share stays whole, and its shard is the heaviest. Further columns are not read.
An empty table gives an empty result. Shards and
slots do not depend on how the rows are partitioned.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wiregrid.llm.common import parts_for, text_of
from wiregrid.session import materialize

#: Groups of a bucket, partial partitions that meet in a task, rows of a block of places.
BUCKET = 20_000
MEET = 64
BLOCK = 10_000
OVERHEAD = 16


def difference(partials: list[list[int]], shards: int) -> list[list[int]]:
    """For every partial partition (sums of up to `shards` slots) the final slot of each slot.

    Empty slots need not be given.
    """
    total = sum(len(p) for p in partials)
    parent = list(range(total))
    heap, node = [], 0
    for number, sums in enumerate(partials):
        slots = sorted(((s, node + j) for j, s in enumerate(sums)), reverse=True)
        slots += [(0, -1)] * (shards - len(slots))
        slots.sort(key=lambda x: -x[0])
        heap.append((slots[-1][0] - slots[0][0], number, slots))
        node += len(sums)
    heapq.heapify(heap)
    count = len(partials)
    while len(heap) > 1:
        _, _, first = heapq.heappop(heap)
        _, _, second = heapq.heappop(heap)
        merged = []
        for (a, x), (b, y) in zip(first, reversed(second), strict=True):
            if x >= 0 and y >= 0:
                parent[y] = x
            merged.append((a + b, x if x >= 0 else y))
        merged.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], count, merged))
        count += 1
    slot = {x: k for k, (_, x) in enumerate(heap[0][2]) if x >= 0} if heap else {}

    def final(x: int) -> int:
        path = []
        while parent[x] != x:
            path.append(x)
            x = parent[x]
        for y in path:
            parent[y] = x
        return slot[x]

    out, node = [], 0
    for sums in partials:
        out.append([final(node + j) for j in range(len(sums))])
        node += len(sums)
    return out


def _bucket_slots(groups: DataFrame, shards: int) -> DataFrame:
    """`groups` (digest, weight, bucket) with the slot in their bucket."""

    def run(table):
        import pyarrow as pa

        # Ties follow the digest, whatever order the rows come in.
        table = table.sort_by([("weight", "descending"), ("digest", "ascending")])
        weights = table.column("weight").to_pylist()
        slots = [x[0] for x in difference([[w] for w in weights], shards)]
        return table.append_column("slot", pa.array(slots, pa.int32()))

    return groups.groupBy("bucket").applyInArrow(
        run, "digest string, weight long, bucket long, slot int"
    )


def _met_slots(sums: DataFrame, shards: int) -> DataFrame:
    """`sums` (bucket, slot, weight, into) with the slot in the bucket they are combined `into`."""

    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda x: (x["bucket"], x["slot"]))
        buckets: dict[int, list[dict]] = {}
        for row in rows:
            buckets.setdefault(row["bucket"], []).append(row)
        finals = difference([[r["weight"] for r in b] for b in buckets.values()], shards)
        for own, slots in zip(buckets.values(), finals, strict=True):
            for row, slot in zip(own, slots, strict=True):
                row["over"] = slot
        schema = [("bucket", pa.int64()), ("slot", pa.int32()), ("weight", pa.int64()),
                  ("into", pa.int64()), ("over", pa.int32())]
        return pa.Table.from_pylist(rows, schema=pa.schema(schema))

    return sums.groupBy("into").applyInArrow(
        run, "bucket long, slot int, weight long, into long, over int"
    )


def group_shards(groups: DataFrame, shards: int, bucket: int = BUCKET) -> DataFrame:
    """(digest, shard) of `groups` (digest, weight): the sums of shards nearly equal."""
    groups, seen = materialize(groups.select("digest", "weight"), "shard-groups")
    buckets = parts_for(seen["rows"], bucket)
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    placed, _ = materialize(_bucket_slots(dealt, shards), "shard-slots")
    while buckets > 1:
        buckets = parts_for(buckets, MEET)
        sums = placed.groupBy("bucket", "slot").agg(F.sum("weight").alias("weight")).withColumn(
            "into", F.pmod(F.col("bucket"), F.lit(buckets))
        )
        met = _met_slots(sums, shards).select("bucket", "slot", "into", "over")
        placed, _ = materialize(
            placed.join(met, ["bucket", "slot"]).select(
                "digest", "weight", F.col("into").alias("bucket"), F.col("over").alias("slot")
            ),
            "shard-slots",
        )
    return placed.select("digest", F.col("slot").alias("shard"))


def places(
    rows: DataFrame, total: int, shards: int, order: tuple[str, ...] = ("uid",)
) -> DataFrame:
    """`rows` (shard and others) with `slot`, gapless from 0 in each shard.

    Rows equal in `order` are one another's like; which of them gets which of their slots is open.
    """
    blocks = parts_for(total, BLOCK * shards)
    blocked = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    held = blocked.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")
    bases = held.select("shard", "_block", before.alias("_base"))
    inner = F.row_number().over(Window.partitionBy("shard", "_block").orderBy(*order)) - 1
    return (
        blocked.withColumn("_inner", inner)
        .join(bases, ["shard", "_block"])
        .withColumn("slot", F.col("_base") + F.col("_inner"))
        .drop("_block", "_inner", "_base")
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of `docs`."""
    text = text_of()
    sized, seen = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("digest"),
        ),
        "shard-sizes",
    )
    groups = sized.groupBy("digest").agg(F.sum("size").alias("weight"))
    dealt, _ = materialize(
        sized.join(group_shards(groups, shards), "digest"), "shard-dealt"
    )
    return places(dealt, seen["rows"], shards, ("doc_id", "digest")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
