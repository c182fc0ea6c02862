"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import math
import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiregrid.session import materialize

#: White space between words: space and the control characters tab to return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by the path all executors can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def parts_for(total: float, each: float, least: int = 1) -> int:
    """How many parts of at most `each` hold `total`."""
    return max(least, math.ceil((total or 0) / each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one pass over one column."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about `most` bytes each; a longer row is alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, in place of the array given."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def stored(df: DataFrame, label: str, *metrics, **options):
    """`materialize`, after which the shuffle files of finished stages can go.

    Spark's cleaner drops the files of a shuffle when the driver's garbage
    collector finds that nothing refers to it any more; left alone, that happens
    late, and a long job would hold the files of all its steps at once.
    """
    table, seen = materialize(df, label, *metrics, **options)
    del df, metrics
    # The first round frees the driver's handles, the second what they held.
    for _ in range(2):
        gc.collect()
        table.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return table, seen


#: Rows of a stored table that may be broadcast, at most.
BROADCAST_ROWS = 100_000


def rows_told(table: DataFrame, seen: dict) -> tuple[DataFrame, dict]:
    """What `materialize` gives, with a table that is met by merges if it has over BROADCAST_ROWS rows.

    That holds for what is made of it alone, too. Spark's own check takes a stored table for as large
    as its files, in which numbers are packed; the driver's hash table has up to twenty times as many bytes.
    """
    return (table if seen["rows"] <= BROADCAST_ROWS else table.hint("merge")), seen


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over `links` (a, b), for nodes that have links.

    Every round a root is hooked onto the least root seen from any of its
    nodes, and then onto that root's own new root; rounds go on until no root
    moves. Minima are combined before each shuffle, so a node with very many
    links is no hot key. Null ends and loops are ignored.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, _ = rows_told(*materialize(both.distinct(), f"{label}-edges"))
    state, _ = rows_told(*materialize(
        edges.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("near"))
        .select("node", F.least("node", "near").alias("root")),
        f"{label}-state",
    ))
    while True:
        seen = edges.join(state.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooks, found = rows_told(*materialize(
            state.join(near, "node")
            .groupBy("root")
            .agg(F.min("seen").alias("seen"))
            .select("root", F.least("root", "seen").alias("over")),
            f"{label}-hooks",
            F.count_if(F.col("over") < F.col("root")).alias("moved"),
        ))
        if not found["moved"]:
            return state
        above = hooks.select(F.col("root").alias("over"), F.col("over").alias("top"))
        tops = hooks.join(above, "over").select("root", "top")
        state, _ = rows_told(*materialize(
            state.join(tops, "root").select("node", F.col("top").alias("root")), f"{label}-state"
        ))


# --- words of many texts at once ---------------------------------------------

#: Bytes of text worked on at a time inside a task.
SLICE_BYTES = 2_000_000
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


_SYMBOL, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """The words of a few texts: bytes, first and end place, text number and a 64-bit hash each."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = b"\n".join(texts)
        data = np.frombuffer(self.buffer, np.uint8)
        if lower:
            data = _LOWER[data]
        space = np.concatenate(([True], _SPACES[data], [True]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        # A sum of mixed (byte, place in the word) pairs. Mixing each of them breaks the algebra by
        # which a polynomial modulo 2**64 has equal values for whole families of texts.
        length = self.ends - self.starts
        inside = np.flatnonzero(~space[1:-1])
        place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
        pairs = (data[inside].astype(np.uint64) + np.uint64(1)) * _SYMBOL
        pairs += (place.astype(np.uint64) + np.uint64(1)) * _PLACE
        sums = np.zeros(len(inside) + 1, np.uint64)
        np.cumsum(mix(pairs), out=sums[1:])
        upto = np.concatenate(([0], np.cumsum(length)))
        self.hash = mix(sums[upto[1:]] - sums[upto[:-1]] + length.astype(np.uint64) * _SYMBOL)


def batches_of(rows: Iterator, column: str) -> Iterator[tuple]:
    """(record batch, texts as bytes) in slices of about SLICE_BYTES; null texts are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in rows:
        whole = batch.column(column)
        binary = pc.fill_null(whole.cast(pa.large_binary()), b"")
        sizes = pc.binary_length(binary).to_numpy(zero_copy_only=False)
        for start, end in slices(sizes, SLICE_BYTES):
            yield batch.slice(start, end - start), binary.slice(start, end - start).to_pylist()
