"""Meetings of the entries of a similarity join: pairs that sizes, places and bits leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs compared in one array operation.
_CHUNK = 1 << 18
#: Entries of one key that meet others at once, and how many of these at a time.
_BLOCK, _COLUMNS = 32, 1 << 12
#: Entries that one of a key must meet on average for that.
_DENSE = 16
#: Up to which size of two sets together bits are folded into how many words; larger ones fill them all.
_FOLDS = {64: 2, 200: 5, 500: 10}
#: Bounds of first tests are looser by this, against rounding; those that pass are tested again.
_LOOSE = 1e-3


def met_in_part(table: pa.Table, t: float, slack: float, maps: list[str], parts: int) -> pa.Table:
    """(lo, hi) of the pairs of entries of one key that may have similarity `t`, each once per part.

    Columns: key, seq, n, the bits `maps` and `wide` (of `parts` longs, or null), depth, pos, own, want,
    early (may meet another as the smaller one) and side (0 meets 1, null all others).
    """
    table = table.set_column(
        table.column_names.index("side"), "side", table.column("side").fill_null(-1)
    )
    columns = [table.column(c).to_numpy() for c in ("seq", "n", "side", "key")]
    order = np.lexsort(columns)
    # Entries that are alone with their key are left out.
    keys = columns[-1][order]
    again = keys[1:] == keys[:-1]
    order = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]
    entries = _Entries(table.take(pa.array(order)), maps, parts)
    found = [
        entries.pairs(left, right, t, slack) for left, right in entries.candidates(t, slack)
    ]
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pa.table({"lo": pairs[new, 0], "hi": pairs[new, 1]})


class _Entries:
    """Entries in order of key, side, size and place in the feed."""

    def __init__(self, table: pa.Table, maps: list[str], parts: int):
        def column(name: str) -> np.ndarray:
            return table.column(name).to_numpy()

        self.key, self.seq, self.early = column("key"), column("seq"), column("early")
        self.n, self.depth = column("n").astype(np.int64), column("depth")
        self.rest = self.n - column("pos")
        self.own, self.want = column("own"), column("want")
        self.side = column("side")
        self.maps = [column(name).view(np.uint64) for name in maps]
        wide = table.column("wide").combine_chunks()
        large = wide.is_valid().to_numpy(zero_copy_only=False)
        self.wide = wide.flatten().to_numpy().view(np.uint64).reshape(-1, parts)
        # Where an entry has its wide bits, or -1.
        self.wide_at = np.where(large, np.cumsum(large) - 1, -1)

    def candidates(self, t: float, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one key, the smaller one early, whose sizes agree; in pieces.

        Of keys with many of them only those that folded bits leave.
        """
        if not len(self.key):
            return
        first, begin, end = self._ranges(t, slack)
        # Places in `first` where a key begins, and how many pairs it has.
        at = np.flatnonzero(np.concatenate([[True], self.key[first][1:] != self.key[first][:-1]]))[: len(first)]
        rows = np.diff(np.append(at, len(first)))
        met = np.add.reduceat(end - begin, at) if len(first) else rows
        crowded = (rows >= _BLOCK) & (met >= _DENSE * rows)
        yield from self._in_blocks(
            [(start, start + count) for start, count in zip(at[crowded], rows[crowded])], first, begin, end, t, slack
        )
        few = ~np.repeat(crowded, rows)
        first, begin, more = first[few], begin[few], (end - begin)[few]
        done = np.cumsum(more)
        start = 0
        while start < len(first):
            before = done[start] - more[start]
            stop = max(start + 1, int(np.searchsorted(done, before + _CHUNK, side="right")))
            left, counts = first[start:stop], more[start:stop]
            so_far = np.cumsum(counts) - counts
            right = np.arange(counts.sum()) + np.repeat(begin[start:stop] - so_far, counts)
            yield np.repeat(left, counts), right
            start = stop

    def _ranges(self, t: float, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries that meet some, and from where to where those are whose sizes agree."""
        run = 2 * np.cumsum(np.concatenate([[0], self.key[1:] != self.key[:-1]]))
        span = int(self.n.max()) + 2
        places = (run + (self.side > 0)) * span + self.n
        largest = np.minimum(np.floor((self.n + slack) / t), span - 2)
        # What an entry can still share bounds the partner's size, too.
        reach = np.floor((self.depth + self.rest + slack) * (1 + t) / t + _LOOSE) - self.n
        largest = np.maximum(np.minimum(largest, reach), 0).astype(np.int64)
        if self.side[0] < 0:
            first = np.flatnonzero(self.early)
            begin = first + 1
        else:
            # The other side's sizes from the least that agrees.
            first = np.flatnonzero(self.side == 0)
            least = np.ceil(t * self.n[first] - slack).astype(np.int64)
            begin = np.searchsorted(places, (run[first] + 1) * span + least)
            largest = np.where(self.early, largest, np.minimum(largest, self.n - 1))
        end = np.searchsorted(
            places, (run[first] + (self.side[first] >= 0)) * span + largest[first], side="right"
        )
        some = end > begin
        return first[some], begin[some], end[some]

    def _in_blocks(
        self, runs: list[tuple[int, int]], first: np.ndarray, begin: np.ndarray, end: np.ndarray, t: float, slack: float
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of `first` with `begin` to `end` that may be similar by places and folded bits.

        `runs` are the places in `first` of one key each. Some entries and all that these meet
        are compared at once, as rows and columns, since the latter lie side by side.
        """
        if not runs:
            return
        c = t / (1 + t)
        spare = self.rest - c * self.n
        folded = {words: self._folded(words) for words in _FOLDS.values()}
        lefts, rights, held = [], [], 0
        for top, bottom in runs:
            for start in range(top, bottom, _BLOCK):
                stop = min(start + _BLOCK, bottom)
                rows = first[start:stop]
                lo, hi = begin[start:stop].min(), end[start:stop].max()
                needs = c * self.n[rows] - self.depth[rows] - slack - _LOOSE
                large = int(self.n[rows].max())
                for left_at in range(lo, hi, _COLUMNS):
                    right_at = min(left_at + _COLUMNS, hi)
                    near = spare[left_at:right_at] >= needs[:, None]
                    both = large + self.n[left_at:right_at]
                    words = next((w for size, w in _FOLDS.items() if both[0] <= size), None)
                    if words:
                        most = np.minimum((1 - 2 * c) * both + 2 * slack + _LOOSE, 1 << 15).astype(np.uint16)
                        near &= _apart(folded[words], rows, left_at, right_at) <= most
                    row, column = np.nonzero(near)
                    column += left_at
                    inside = (column >= begin[start:stop][row]) & (column < end[start:stop][row])
                    lefts.append(rows[row[inside]])
                    rights.append(column[inside])
                    held += len(lefts[-1])
                    if held >= _CHUNK:
                        yield np.concatenate(lefts), np.concatenate(rights)
                        lefts, rights, held = [], [], 0
        if held:
            yield np.concatenate(lefts), np.concatenate(rights)

    def _folded(self, words: int) -> list[np.ndarray]:
        """The bits in so many words: sets differ in no fewer tokens than these differ in bits."""
        return [np.bitwise_xor.reduce(self.maps[i::words]) for i in range(min(words, len(self.maps)))]

    def pairs(self, left: np.ndarray, right: np.ndarray, t: float, slack: float) -> np.ndarray:
        """Those of the candidates that places, sides and bits leave, as (lo, hi)."""
        both = self.n[left] + self.n[right]
        needed = t / (1 + t) * both - slack
        left, right, most = _kept(
            self.depth[left] + np.minimum(self.rest[left], self.rest[right]) >= needed,
            left, right, both - 2 * needed,
        )
        left, right, most = _kept(
            (self.own[left] == self.want[right])
            & (self.want[left] == self.own[right])
            & (self.depth[left] == self.depth[right])
            & np.where(self.n[left] <= self.n[right], self.early[left], self.early[right])
            & ((self.side[left] < 0) | (self.seq[left] < self.seq[right])),
            left, right, most,
        )
        apart = np.zeros(len(left), np.int64)
        for part in self.maps:
            apart += np.bitwise_count(part[left] ^ part[right])
            left, right, most, apart = _kept(apart <= most, left, right, most, apart)
        large = (self.wide_at[left] >= 0) & (self.wide_at[right] >= 0)
        fit = ~large
        differ = self.wide[self.wide_at[left[large]]] ^ self.wide[self.wide_at[right[large]]]
        fit[large] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most[large]
        one, two = self.seq[left[fit]], self.seq[right[fit]]
        return np.column_stack([np.minimum(one, two), np.maximum(one, two)])


def _apart(bits: list[np.ndarray], rows: np.ndarray, start: int, stop: int) -> np.ndarray:
    """In how many bits each of `rows` differs from each entry from `start` to `stop`."""
    apart = np.zeros((len(rows), stop - start), np.uint16)
    for word in bits:
        apart += np.bitwise_count(word[rows][:, None] ^ word[start:stop])
    return apart


def _kept(keep: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(array[keep] for array in arrays)
