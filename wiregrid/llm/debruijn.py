"""Repeated passages of words by compaction of a de Bruijn graph.

An edge is a window of `length` words, its ends are the windows of one word
less. Only windows whose anchor two documents have can be repeated, so the graph
is made of those:

1. Runs of windows with one anchor are met by anchor. Equal runs are one path
   that is known to be repeated: all but the smallest document's are removed
   whole. Where documents have different runs with one anchor, the smallest
   document's run of each kind is cut out as a segment.
2. The windows of the segments become edges. Equal edges are counted; those of
   two segments or more make up the graph.
3. Nodes with one edge in and one out do not branch. Edges join their nodes'
   degrees, and edges that follow each other in their source over such nodes
   are compacted into a path, with the source coordinates of its first edge.
4. Where a segment runs along a path that has its source in a smaller document,
   the words of both, looked up by their coordinates, are compared. Of the
   segments only what is equal word for word is removed; whole runs (step 1)
   are told by 88 bits of hashes alone.

Defined results: null texts have no words. Texts with fewer words than a window
are never cut, but their white space is normalised like that of all. Rows that
share a doc_id are the same document: what they share is no repeat. Rows with a
null doc_id are not cut, and others are not cut for them. Further columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wiregrid.llm.anchors import Cut, cut_out, merged, rolling
from wiregrid.llm.common import Words, batches_of, mix, stored
from wiregrid.llm.run_marks import HOT, WHOLE, marked_texts, said_of_runs

#: Windows of 50 words, anchors of 10.
WORDS = Cut(length=50, anchor=10)


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts)
    return words.hash, np.diff(words.first)


def segments(marked: DataFrame, cut: Cut) -> DataFrame:
    """(key, segment, doc_id, place, size): words from `place` on, one blank between.

    A row without a key is a repeat for sure. A segment that a smaller document
    of the same slice has too comes without its words.
    """

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, texts in batches_of(rows, "text"):
            words = Words(texts)
            runs, says = said_of_runs(batch, words.hash, np.diff(words.first), cut)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            columns: list[list] = [[], [], [], [], []]

            def put(*row: object) -> None:
                for column, value in zip(columns, row, strict=True):
                    column.append(value)

            known = runs.take(says == WHOLE)
            whole = zip(
                known.doc.tolist(), known.first.tolist(),
                (known.first + known.size + cut.length - 1).tolist(), strict=True,
            )
            for doc, spans in groupby(sorted(whole), key=lambda x: x[0]):
                start = int(known.starts[doc])
                for a, b in merged([x[1:] for x in spans]):
                    put(None, None, int(ids[doc]), a - start, b - a)
            open_ = says != WHOLE
            cuts, _ = cut_out(runs.take(open_), says[open_] == HOT, words.hash, cut)
            last = cuts.first + cuts.size + cut.length - 2
            found = zip(
                ids[cuts.doc].tolist(), words.starts[cuts.first].tolist(),
                words.ends[last].tolist(), (cuts.first - cuts.starts[cuts.doc]).tolist(),
                (last - cuts.first + 1).tolist(), strict=True,
            )
            holder: dict[bytes, int] = {}
            for doc, a, b, place, size in sorted(found):
                text = b" ".join(words.buffer[a:b].split())
                own = holder.setdefault(text, doc) == doc
                key = hashlib.blake2b(text, digest_size=16).digest()
                put(key, text if own else None, doc, place, size)
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["key", "segment", "doc_id", "place", "size"],
            )

    return marked.mapInArrow(
        run, "key binary, segment binary, doc_id long, place long, size long"
    )


def edges(paths: DataFrame, cut: Cut) -> DataFrame:
    """(seg, at, holder, e1, e2, src, dst): every window of `paths` (seg, segment, holder)."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, texts in batches_of(rows, "segment"):
            words = Words(texts)
            count = np.maximum(np.diff(words.first) - cut.length + 1, 0)
            of = np.repeat(np.arange(len(texts)), count)
            at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            first = words.first[of] + at
            node = mix(rolling(words.hash, cut.length - 1))
            one = mix(rolling(words.hash, cut.length))
            two = mix(rolling(mix(words.hash + np.uint64(1)), cut.length))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("seg").take(pa.array(of)),
                    pa.array(at.astype(np.int64)),
                    batch.column("holder").take(pa.array(of)),
                    *[pa.array(x.view(np.int64)) for x in
                      (one[first], two[first], node[first], node[first + 1])],
                ],
                names=["seg", "at", "holder", "e1", "e2", "src", "dst"],
            )

    return paths.select("seg", "holder", "segment").mapInArrow(
        run, "seg long, at long, holder long, e1 long, e2 long, src long, dst long"
    )


def compacted(graph: DataFrame) -> DataFrame:
    """Edges (e1, e2, low, seg, at, src, dst) with the path they lie on: `path_at`, its first place.

    A path is (seg, path_at): it begins where its source does, or at a node that branches.
    """
    ends = graph.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(
        graph.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    plain = nodes.where("out = 1 AND in = 1").select(F.col("node").alias("src"), F.lit(True).alias("plain"))
    source = Window.partitionBy("seg").orderBy("at")
    follows = F.coalesce("plain", F.lit(False)) & (F.lag("at").over(source) == F.col("at") - 1)
    begin = F.when(~F.coalesce(follows, F.lit(False)), F.col("at"))
    return (
        graph.join(plain, "src", "left")
        .withColumn("begin", begin)
        .withColumn("path_at", F.last("begin", ignorenulls=True).over(source))
        .select("e1", "e2", "low", "seg", "at", "path_at")
    )


def _words_at(text: Column, first: Column, count: Column) -> Column:
    return F.slice(F.split(text.cast("string"), " "), (first + 1).cast("int"), count.cast("int"))


def spans(docs: DataFrame, cut: Cut = WORDS) -> DataFrame:
    """(doc_id, first, end) in words: all that is repeated, with overlaps, of `docs` (doc_id, text)."""
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    found, _ = stored(segments(marked_texts(texts, cut, word_symbols), cut), "graph-segments")
    held = found.where("segment IS NOT NULL")
    paths, _ = stored(
        held.groupBy("key")
        .agg(F.min("doc_id").alias("holder"), F.first("segment").alias("segment"))
        .withColumn("seg", F.monotonically_increasing_id()),
        "graph-paths",
    )
    every, _ = stored(edges(paths, cut), "graph-edges")
    graph = (
        every.groupBy("e1", "e2")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("holder", "seg", "at", "src", "dst")).alias("s"),
        )
        .where("n > 1")
        .select("e1", "e2", F.col("s.holder").alias("low"), "s.seg", "s.at", "s.src", "s.dst")
    )
    graph, _ = stored(graph, "graph")
    along = compacted(graph).select(
        "e1", "e2", "low", F.col("seg").alias("from_seg"), F.col("at").alias("from_at"), "path_at"
    )
    walked = every.join(along, ["e1", "e2"]).where("low < holder")
    walk = Window.partitionBy("seg").orderBy("at")
    same = F.struct("from_seg", "path_at", F.col("from_at") - F.col("at"))
    fresh = (F.lag("at").over(walk) == F.col("at") - 1) & (F.lag(same).over(walk) == same)
    steps = walked.withColumn("turn", F.when(~F.coalesce(fresh, F.lit(False)), F.col("at")))
    steps = steps.withColumn("turn", F.last("turn", ignorenulls=True).over(walk))
    claimed = steps.groupBy("seg", "turn").agg(
        F.min("from_seg").alias("from_seg"),
        F.min("from_at").alias("from_at"),
        (F.count(F.lit(1)) + cut.length - 1).alias("count"),
    )
    own = paths.select("seg", "key", "segment")
    source = paths.select(F.col("seg").alias("from_seg"), F.col("segment").alias("original"))
    told = (
        claimed.join(own, "seg")
        .join(source, "from_seg")
        .where(
            _words_at(F.col("segment"), F.col("turn"), F.col("count"))
            == _words_at(F.col("original"), F.col("from_at"), F.col("count"))
        )
        .select("key", F.col("turn").alias("skip"), "count")
    )
    place, size = F.col("place"), F.col("size")
    known = found.where("key IS NULL").select(
        "doc_id", place.alias("first"), (place + size).alias("end")
    )
    owners = found.where("key IS NOT NULL").select("key", "doc_id", "place", "size").join(
        paths.select("key", "holder"), "key"
    )
    whole = owners.where("doc_id > holder").select(
        "doc_id", place.alias("first"), (place + size).alias("end")
    )
    inner = owners.where("doc_id = holder").join(told, "key").select(
        "doc_id",
        (F.col("place") + F.col("skip")).alias("first"),
        (F.col("place") + F.col("skip") + F.col("count")).alias("end"),
    )
    return known.unionByName(whole).unionByName(inner)


def cut_repeats(docs: DataFrame, cut: Cut = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; `kept` has the words left, one blank between."""
    gone, _ = stored(spans(docs, cut), "graph-spans")
    gone = gone.groupBy("doc_id").agg(
        F.collect_list(F.struct("first", "end")).alias("_spans")
    )
    met = docs.select("doc_id", "text").join(gone.hint("merge"), "doc_id", "left")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, texts in batches_of(rows, "text"):
            columns: list[list] = [[], [], []]
            for text, found in zip(texts, batch.column("_spans").to_pylist(), strict=True):
                words = text.split()
                total, removed = len(words), 0
                for a, b in reversed(merged([(x["first"], x["end"]) for x in found or []])):
                    del words[a:b]
                    removed += b - a
                row = (total, removed, b" ".join(words))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()),
                 *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return met.select("doc_id", "text", "_spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept binary"
    )
