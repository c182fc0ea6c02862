"""Best-fit packing of token pieces into sequences, improved by swaps.

Pieces are dealt at random into groups of bounded size, so each group has the
same mix of lengths. In a group every piece, longest first, goes where the
least room is left. Then the emptiest sequence is emptied as far as swaps
allow: one of its pieces moves, or is exchanged for one or two shorter pieces of
another sequence, or two of them for one, whenever this raises the sum of
squared fills. The emptiest sequences of all groups meet in fewer groups and are
packed anew, until one group is left; so the waste of many groups does not add
up, and no group or task holds more than a bounded number of pieces.

Defined results: null and empty texts are one piece, of the end token. A full
piece is a sequence of its own. Rows that share a doc_id, or have none, are
packed as rows of their own. Columns of the names that the result adds are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wiregrid.llm.common import batches_of, parts_for
from wiregrid.llm.tokens import drops_white, encode_ended, encoder
from wiregrid.session import materialize

#: Tokens of a sequence, pieces of a group, sequences a group hands on, groups that meet.
CAPACITY = 2048
GROUP = 20_000
HANDED = 64
MEET = 64


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of `docs` (doc_id, text)."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        worker = encoder(tokenizer, drops_white)
        for batch, texts in batches_of(rows, "text"):
            ids, first = encode_ended(worker, texts, 0)
            raw = ids.astype("<u4").tobytes()
            sizes = np.diff(first)
            count = -(-sizes // capacity)
            of = np.repeat(np.arange(len(texts)), count)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(sizes[of] - start, capacity)
            at = (first[of] + start).tolist()
            sums = [
                zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(of)).cast(pa.int64()),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start.astype(np.int64)),
                    pa.array(length.astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Piece numbers of every bin; each piece, longest first, goes where the least room is left."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # has bit r if a bin has r of room
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = some >> n
        if fitting:
            r = (fitting & -fitting).bit_length() - 1 + n
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r - n:
            room[r - n].append(b)
            some |= 1 << (r - n)
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A number of bins that no packing goes below.

    For any size t: pieces over half the capacity lie apart, and what is at least t long and not
    over half fits only beside such as leave t; the largest bound of all t counts.
    """
    n = np.sort(np.asarray(lengths, np.int64))
    upto = np.concatenate(([0], np.cumsum(n)))
    half = int(np.searchsorted(n, capacity // 2, "right"))
    sizes = np.unique(np.concatenate(([0], n[:half])))
    alone = np.searchsorted(n, capacity - sizes, "right")
    room = (alone - half) * capacity - (upto[alone] - upto[half])
    beside = upto[half] - upto[np.searchsorted(n, sizes, "left")]
    bounds = len(n) - half + np.maximum(0, -(-(beside - room) // capacity))
    return int(bounds.max())


class Search:
    """Swaps between the bins that are not full.

    What an open bin can give back is kept in flat arrays, a row for nothing and for each length of
    one or two of its pieces, so that all partners of a bin are looked at in a few array operations.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
        self.held = 0
        #: By row: the bin, what is taken of it, the room that makes, the number of pieces.
        self.rows = np.zeros((4, 1024), np.int64)
        self.pieces: list[tuple[int, ...]] = []
        self.span: dict[int, tuple[int, int]] = {}
        for k in range(len(bins)):
            self._set(k)

    def _sums(self, k: int) -> dict[int, tuple[int, ...]]:
        """Pieces of bin k by their length: none, one or two, as few as make that length."""
        own = {self.lengths[i]: i for i in self.bins[k]}
        twice = sorted(self.bins[k], key=lambda i: self.lengths[i])
        found: dict[int, tuple[int, ...]] = {0: ()}
        found.update((n, (i,)) for n, i in own.items())
        ones = list(own.items())
        for x, (n, i) in enumerate(ones):
            for m, j in ones[x + 1 :]:
                found.setdefault(n + m, (i, j))
        for i, j in zip(twice, twice[1:], strict=False):
            if self.lengths[i] == self.lengths[j]:
                found.setdefault(2 * self.lengths[i], (i, j))
        return found

    def _set(self, k: int) -> None:
        """Take up what bin k holds now."""
        if k in self.span:
            start, stop = self.span.pop(k)
            self.rows[2, start:stop] = -1
        self.fill[k] = sum(self.lengths[i] for i in self.bins[k])
        if not 0 < self.fill[k] < self.capacity:
            return
        sums = self._sums(k)
        if self.held + len(sums) > self.rows.shape[1]:
            self._compact(len(sums))
        start, stop = self.held, self.held + len(sums)
        taken = np.fromiter(sums, np.int64, len(sums))
        self.rows[0, start:stop] = k
        self.rows[1, start:stop] = taken
        self.rows[2, start:stop] = self.capacity - self.fill[k] + taken
        self.rows[3, start:stop] = [len(x) for x in sums.values()]
        self.pieces += sums.values()
        self.span[k], self.held = (start, stop), stop

    def _compact(self, more: int) -> None:
        """Leave out the rows of bins that changed and make room for as many again."""
        live = np.flatnonzero(self.rows[2, : self.held] >= 0)
        rows = np.zeros((4, 2 * (len(live) + more) + 1024), np.int64)
        rows[:, : len(live)] = self.rows[:, live]
        self.pieces = [self.pieces[i] for i in live.tolist()]
        self.rows, self.held, at = rows, len(live), 0
        for k in list(self.span):
            size = self.span[k][1] - self.span[k][0]
            self.span[k] = (at, at + size)
            at += size

    def _best(self, k: int) -> tuple | None:
        """The exchange of pieces of bin k that raises the squared fill most, as (bin, give, take)."""
        bins, taken, room, count = self.rows[:, : self.held]
        others = bins != k
        best, found = 0, None
        for a, give in self._sums(k).items():
            if not a:
                continue
            at = np.flatnonzero((room >= a) & (taken < a) & others & (count <= 3 - len(give)))
            if not len(at):
                continue
            d = a - taken[at]
            gain = 2 * d * (self.fill[bins[at]] - self.fill[k] + d)
            top = int(gain.argmax())
            if gain[top] > best:
                best, found = int(gain[top]), (int(bins[at[top]]), give, self.pieces[at[top]])
        return found

    def run(self, passes: int | None = None) -> list[list[int]]:
        """Empty the bins one after the other, emptiest first, until no exchange raises the fill.

        It ends before that where no packing has fewer bins. `passes` bounds the rounds over all
        open bins; the packing does not.
        """
        least = least_bins(self.lengths, self.capacity)
        count = int((self.fill > 0).sum())
        while count > least and (passes is None or passes > 0):
            changed = False
            for k in sorted(self.span, key=lambda k: (self.fill[k], k)):
                while k in self.span and (found := self._best(k)):
                    other, give, take = found
                    self.bins[k] = [i for i in self.bins[k] if i not in give] + list(take)
                    self.bins[other] = [i for i in self.bins[other] if i not in take] + list(give)
                    self._set(k)
                    self._set(other)
                    changed = True
                count = int((self.fill > 0).sum())
                if count <= least:
                    break
            if not changed:
                break
            passes = passes and passes - 1
        return [b for b in self.bins if b]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers, each at most `capacity` long, as few as the method finds."""
    return Search(lengths, best_fit(lengths, capacity), capacity).run()


def _packed(rest: DataFrame, level: int, capacity: int, handed: int) -> DataFrame:
    """`rest` with sequence_id, offset and `again`: whether its sequence is to be packed anew."""

    def run(table):
        import pyarrow as pa

        group = table.column("group")[0].as_py()
        lengths = table.column("length").to_pylist()
        bins = pack_lengths(lengths, capacity)
        bins.sort(key=lambda b: sum(lengths[i] for i in b))
        bin_of, offset, again = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                bin_of[i], offset[i], again[i] = k, at, k < handed
                at += lengths[i]
        base = level << 56 | group << 24
        out = table.append_column("sequence_id", pa.array(base + bin_of))
        out = out.append_column("offset", pa.array(offset))
        return out.append_column("again", pa.array(again.astype(bool)))

    schema = StructType.fromDDL("sequence_id long, offset long, again boolean")
    return rest.groupBy("group").applyInArrow(run, StructType([*rest.schema.fields, *schema.fields]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """`pieces` (length, any others) with sequence_id and offset."""
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # All columns given travel in one, so that none clashes with a name used here.
    stored, seen = materialize(
        pieces.select(
            F.struct(*own).alias("row"), "length", F.monotonically_increasing_id().alias("uid")
        ),
        "pack-pieces",
        F.count_if(F.col("length") < capacity).alias("short"),
    )
    done = stored.where(F.col("length") == capacity).select(
        "row", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    groups = parts_for(seen["short"] or 0, group)
    rest = stored.where(F.col("length") < capacity).withColumn(
        "group", F.pmod(F.xxhash64("uid"), F.lit(groups))
    )
    level = 0
    while True:
        last = groups == 1
        packed, _ = materialize(
            _packed(rest, level, capacity, 0 if last else HANDED), "pack-level"
        )
        done = done.unionByName(packed.where("NOT again").select("row", "sequence_id", "offset"))
        if last:
            return done.select("row.*", "sequence_id", "offset")
        level, groups = level + 1, parts_for(groups, MEET)
        rest = packed.where("again").select(
            "row", "length", "uid", F.pmod(F.col("group"), F.lit(groups)).alias("group")
        )
