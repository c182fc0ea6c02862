"""Repeated byte strings by column-wise construction of a collection's suffix order.

All strings of `length` bytes that occur in two documents or more are found,
and of those every occurrence outside the smallest document is removed.

1. Marks. Of the 16-byte strings inside a window the one with the least hash is
   the window's anchor; equal windows have equal anchors. Runs of windows with
   one anchor are met by anchor: a run that a smaller document has too is a
   repeat as a whole. That is what most repeats are, and no text moves for it.
2. Segments. Where documents have different runs with one anchor, the smallest
   document's run of each kind is cut out as a segment. Very common anchors are
   cut into single windows, dealt by their own hash, so a passage that a third
   of all documents hold is no hot group.
3. Columns. The segments of one anchor meet in one part. There the Burrows-
   Wheeler transform and the common prefixes of the collection are built one
   column at a time: each round puts one more symbol of every segment, from its
   end, in place, by counting symbols, and updates the common prefixes by
   minima over the ranges between equal symbols. Rows whose common prefix has
   `length` bytes are one repeated string; its smallest document keeps it.
4. Spans come back to their documents, are merged and cut out.

The files of the external-memory method are the arrays of one part here, read
and written front to back each round: a part holds a bounded number of bytes,
and tasks leave nothing on a machine's own disk.

Defined results: null texts are empty. Texts shorter than `length` are never
cut. Rows that share a doc_id are the same document: what they share is no
repeat. Rows with a null doc_id are left as they are, and others are not cut
for them. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrid.llm.anchors import Cut, begins, cut_out, merged, rolling
from wiregrid.llm.common import batches_of, parts_for, slices, stored
from wiregrid.llm.run_marks import HOT, WHOLE, marked_texts, said_of_runs

#: Windows of 50 bytes, anchors of 16.
BYTES = Cut(length=50, anchor=16)


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.fromiter(map(len, texts), np.int64, len(texts))


#: Bytes of segments that a task cuts out at a time.
_CUT_BYTES = 8_000_000


def _joined(doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of one text as maximal ones; later texts have later places."""
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > end[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc))[: len(at)] - 1
    return doc[at], first[at], end[last]


def _binaries(data: np.ndarray, first: np.ndarray, size: np.ndarray):
    """The bytes from each of `first` on as an Arrow array."""
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    taken = data[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(taken)]
    return pa.Array.from_buffers(pa.binary(), len(size), buffers)


def segments(marked: DataFrame, cut: Cut) -> DataFrame:
    """(part, segment, doc_id, place, size): bytes from `place` on that are marked.

    `part` is a hash that all equal windows share. A segment without bytes is
    one that a smaller document has too: a repeat for sure.
    """

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def found(part: np.ndarray, segment, doc: np.ndarray, place: np.ndarray, size: np.ndarray):
            arrays = [pa.array(c, pa.int64()) for c in (part, doc, place, size)]
            names = ["part", "segment", "doc_id", "place", "size"]
            return pa.RecordBatch.from_arrays([arrays[0], segment, *arrays[1:]], names=names)

        for batch, texts in batches_of(rows, "text"):
            data, sizes = byte_symbols(texts)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            runs, says = said_of_runs(batch, data, sizes, cut)
            known = runs.take(says == WHOLE)
            doc, first, end = _joined(known.doc, known.first, known.first + known.size + cut.length - 1)
            none = np.zeros(len(doc), np.int64)
            yield found(none, pa.nulls(len(doc), pa.binary()), ids[doc], first - runs.starts[doc], end - first)
            open_ = says != WHOLE
            cuts, part = cut_out(runs.take(open_), says[open_] == HOT, data, cut)
            order = np.lexsort((cuts.first, part, ids[cuts.doc]))
            cuts, part = cuts.take(order), part[order]
            size = cuts.size + cut.length - 1
            for x, y in slices(size, _CUT_BYTES):
                doc, first = cuts.doc[x:y], cuts.first[x:y]
                segment = _binaries(data, first, size[x:y])
                code = segment.dictionary_encode().indices.to_numpy()
                holder = np.full(y - x, np.iinfo(np.int64).max)
                np.minimum.at(holder, code, ids[doc])
                segment = pc.if_else(pa.array(ids[doc] == holder[code]), segment, pa.scalar(None, pa.binary()))
                yield found(part[x:y], segment, ids[doc], first - cuts.starts[doc], size[x:y])

    return marked.mapInArrow(
        run, "part long, segment binary, doc_id long, place long, size long"
    )


#: Stands for the beginning of a string; no byte of UTF-8 text.
_BEGIN = 255


class Columns:
    """The Burrows-Wheeler transform and common prefixes of some strings, column by column.

    The first rows are the empty suffixes, in the order of the strings. `bwt`
    has the symbol before each suffix, `common` the length of the prefix shared
    with the row above, up to `most` (254 at most).
    """

    def __init__(self, strings: list[bytes], most: int):
        self.count, self.most = len(strings), most
        self.sizes = np.fromiter(map(len, strings), np.int64, self.count)
        data = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.cumsum(self.sizes)
        self.bwt = data[ends - 1].copy()
        self.common = np.zeros(self.count, np.uint8)
        live, rows = np.arange(self.count), np.arange(self.count)
        for depth in range(1, int(self.sizes.max(initial=0)) + 1):
            here = self.sizes[live] >= depth
            live, rows = live[here], rows[here]
            # The symbol before the suffix of this depth, if there is one.
            before = np.full(len(live), _BEGIN, np.uint8)
            more = self.sizes[live] > depth
            before[more] = data[ends[live[more]] - depth - 1]
            rows = self._insert(rows, before)

    def _ordered(self) -> np.ndarray:
        """Rows by the suffix that begins with their symbol, as far as they have one."""
        order = np.argsort(self.bwt, kind="stable")
        return order[: len(order) - np.count_nonzero(self.bwt == _BEGIN)]

    def _insert(self, rows: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Puts in the suffixes that begin with the symbols at `rows`; returns their rows."""
        order = self._ordered()
        place = np.zeros(len(self.bwt), np.int64)
        place[order] = np.arange(len(order))
        ranks = place[rows]
        old = np.ones(self.count + len(order), bool)
        old[self.count + ranks] = False
        bwt = np.empty(len(old), np.uint8)
        bwt[old] = self.bwt
        bwt[self.count + ranks] = before
        # Common prefixes change at the new rows and at the rows below them.
        touched = np.zeros(len(order) + 1, bool)
        touched[ranks] = True
        touched[ranks + 1] = True
        touched[[0, len(order)]] = False
        at = np.flatnonzero(touched)
        upper, lower = order[at - 1], order[at]
        ranges = np.empty(2 * len(at), np.int64)
        ranges[::2], ranges[1::2] = upper + 1, lower + 1
        common = np.empty(len(old), np.uint8)
        common[old] = self.common
        common[self.count + ranks] = 0
        if len(at):
            # A range that does not ascend belongs to two symbols; its value is not used.
            least = np.minimum.reduceat(np.append(self.common, np.uint8(0)), ranges)[::2]
            same = self.bwt[upper] == self.bwt[lower]
            common[self.count + at] = np.where(same, np.minimum(least + 1, self.most), 0)
        self.bwt, self.common = bwt, common
        return self.count + ranks

    def windows(self) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(strings, depth, groups) for all suffixes of `most` symbols or more, by depth.

        Suffixes of one group begin with the same `most` symbols.
        """
        order = self._ordered()
        step = np.zeros(len(self.bwt), np.int64)
        step[order] = self.count + np.arange(len(order))
        groups = np.cumsum(self.common < self.most)
        live, rows = np.arange(self.count), np.arange(self.count)
        for depth in range(1, int(self.sizes.max(initial=0)) + 1):
            here = self.sizes[live] >= depth
            live, rows = live[here], step[rows[here]]
            if depth >= self.most:
                yield live, depth, groups[rows]


#: Bytes of strings whose columns are built together, so that they stay in a processor's cache.
_TOGETHER = 100_000


def meeting(data: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Which strings hold a window that occurs twice in `data`; the others share none with any string.

    By hashes: a string may be told too whose window only shares its hash.
    """
    told = np.zeros(len(sizes), bool)
    if len(data) < length:
        return told
    hashes = rolling(data, length)
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(hashes)]
    left = np.cumsum(sizes)[of] - np.arange(len(hashes))
    at = np.flatnonzero(left >= length)
    order = at[np.argsort(hashes[at])]
    hashes = hashes[order]
    twice = np.flatnonzero(hashes[1:] == hashes[:-1])
    told[of[order[twice]]] = True
    told[of[order[twice + 1]]] = True
    return told


def _in_columns(strings: list[bytes], holder: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) of the windows that a string of a smaller holder has too."""
    columns = Columns(strings, length)
    found = list(columns.windows())
    least = np.full(len(columns.common) + 1, np.iinfo(np.int64).max)
    for of, _, group in found:
        np.minimum.at(least, group, holder[of])
    string, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for of, depth, group in found:
        hit = least[group] < holder[of]
        string.append(of[hit])
        place.append(columns.sizes[of[hit]] - depth)
    return np.concatenate(string), np.concatenate(place)


def window_repeats(
    data: np.ndarray, sizes: np.ndarray, holder: np.ndarray, part: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(string, place), in order, of the windows that a string of a smaller holder and the same part has too.

    The strings lie in `data` one after another.
    """
    open_ = np.flatnonzero(meeting(data, sizes, length))
    _, group, count = np.unique(part[open_], return_inverse=True, return_counts=True)
    open_, group = open_[count[group] > 1], group[count[group] > 1]
    open_ = open_[np.argsort(group, kind="stable")]
    edges = begins(part[open_])
    weights = np.add.reduceat(sizes[open_], edges) if len(open_) else np.zeros(0, np.int64)
    edges = np.append(edges, len(open_))
    starts, raw = np.cumsum(sizes) - sizes, data.tobytes()
    string, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in slices(weights, _TOGETHER):
        own = open_[edges[x] : edges[y]]
        ends = (starts[own] + sizes[own]).tolist()
        texts = [raw[a:b] for a, b in zip(starts[own].tolist(), ends, strict=True)]
        of, at = _in_columns(texts, holder[own], length)
        string.append(own[of])
        place.append(at)
    string, place = np.concatenate(string), np.concatenate(place)
    order = np.lexsort((place, string))
    return string[order], place[order]


def repeated_windows(strings: list[bytes], holder: np.ndarray, length: int) -> list[np.ndarray]:
    """For every string the places of those windows that a string of a smaller holder has too."""
    if not strings:
        return []
    data, sizes = byte_symbols(strings)
    string, place = window_repeats(data, sizes, holder, np.zeros(len(strings), np.int64), length)
    return np.split(place, np.searchsorted(string, np.arange(1, len(strings))))


def _runs(string: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first byte, end) of consecutive window places."""
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) > 1) | (np.diff(string) > 0)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(place))[: len(at)] - 1
    return string[at], place[at], place[last] + length


def _texts_of(values) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of binaries one after another, and the bytes of each."""
    import pyarrow as pa

    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def repeated_spans(cuts: DataFrame, cut: Cut, n_parts: int) -> DataFrame:
    """(doc_id, first, end): the repeated bytes that the segments of each part tell of."""

    def run(table):
        import pyarrow as pa

        codes = table.column("segment").combine_chunks().dictionary_encode()
        data, sizes = _texts_of(codes.dictionary)
        code = codes.indices.to_numpy(zero_copy_only=False)
        doc = table.column("doc_id").to_numpy()
        place = table.column("place").to_numpy()
        holder = np.full(len(sizes), np.iinfo(np.int64).max)
        np.minimum.at(holder, code, doc)
        anchor = np.zeros(len(sizes), np.int64)
        anchor[code] = table.column("part").to_numpy()
        whole = np.flatnonzero(doc > holder[code])
        own = np.flatnonzero(doc <= holder[code])
        # The spans of a string belong to every row of it that its holder has.
        string, first, end = _runs(*window_repeats(data, sizes, holder, anchor, cut.length), cut.length)
        begin = np.searchsorted(string, code[own])
        count = np.searchsorted(string, code[own], side="right") - begin
        of = np.repeat(own, count)
        at = np.arange(len(of)) + np.repeat(begin - np.cumsum(count) + count, count)
        out = {
            "doc_id": np.concatenate((doc[whole], doc[of])),
            "first": np.concatenate((place[whole], place[of] + first[at])),
            "end": np.concatenate((place[whole] + sizes[code[whole]], place[of] + end[at])),
        }
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    dealt = cuts.withColumn("group", F.pmod(F.col("part"), F.lit(n_parts)))
    return dealt.groupBy("group").applyInArrow(run, "doc_id long, first long, end long")


def spans(docs: DataFrame, cut: Cut = BYTES) -> DataFrame:
    """(doc_id, first, end) in bytes: all that is repeated, with overlaps, of `docs` (doc_id, text)."""
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    cuts, seen = stored(
        segments(marked_texts(texts, cut, byte_symbols), cut),
        "suffix-segments",
        F.sum(F.octet_length("segment")).alias("bytes"),
    )
    known = cuts.where("segment IS NULL").select(
        "doc_id", F.col("place").alias("first"), (F.col("place") + F.col("size")).alias("end")
    )
    open_ = cuts.where("segment IS NOT NULL").select("part", "segment", "doc_id", "place")
    return known.unionByName(repeated_spans(open_, cut, parts_for(seen["bytes"] or 0, cut.part)))


def cut_repeats(docs: DataFrame, cut: Cut = BYTES) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans and kept (binary): the text without what is repeated.

    Columns of these names are replaced.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    own = [c for c in docs.columns if c not in added]
    gone, _ = stored(spans(docs, cut), "suffix-spans")
    gone = gone.groupBy("doc_id").agg(
        F.collect_list(F.struct("first", "end")).alias("_spans")
    )
    met = docs.select(*own).join(gone.hint("merge"), "doc_id", "left").select(*own, "_spans")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, texts in batches_of(rows, "text"):
            columns = [[], [], [], []]
            for text, found in zip(texts, batch.column("_spans").to_pylist(), strict=True):
                gone = merged([(x["first"], x["end"]) for x in found or []])
                edges = [0, *(place for span in gone for place in span), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                row = (len(text), len(text) - len(kept), len(gone), kept)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            arrays = [batch.column(c) for c in own] + [pa.array(c, pa.int64()) for c in columns[:3]]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(columns[3], pa.binary())], names=[*own, *added]
            )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in own])
    return met.mapInArrow(
        run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
