"""Anchors: marks that equal windows of symbols share.

Of the short strings inside a window the one with the least hash is the
window's anchor. Equal windows have equal anchors, so only runs of windows
whose anchor two documents have can hold anything that is repeated. A text is
a row of symbols: its bytes, or hashes of its words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from wiregrid.llm.common import mix

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows whose anchors are told together, so that they stay in a processor's cache.
_BLOCK = 1 << 14


@dataclass(frozen=True)
class Cut:
    """length: symbols of a window. anchor: symbols of an anchor. run: most windows of a run.
    hot: an anchor with more different runs than this is very common.
    block: bytes of text per block of anchors. part: bytes per part of what is cut out."""

    length: int = 50
    anchor: int = 16
    run: int = 48
    hot: int = 2000
    block: int = 2_000_000
    part: int = 3_000_000


#: The symbols of some texts one after another, and how many each text has.
Symbols = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k symbols in a row, by joining halves."""
    if k == 1:
        return data.astype(np.uint64) + np.uint64(1)
    half = rolling(data, k // 2)
    wide = half[: len(half) - k // 2] * np.uint64(pow(int(BASE), k // 2, 1 << 64))
    wide += half[k // 2 :]
    if k % 2:
        wide = wide[:-1] * BASE + data[k - 1 :]
    return wide


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    over = width - have
    return np.minimum(values[: len(values) - over], values[over:]) if over else values


@dataclass
class Runs:
    """Runs of windows with one anchor: text number, first window, windows, anchor of each.

    Places count over all symbols; `starts` has the first symbol of each text.
    """

    doc: np.ndarray
    first: np.ndarray
    size: np.ndarray
    anchor: np.ndarray
    starts: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(
            self.doc[which], self.first[which], self.size[which], self.anchor[which], self.starts
        )


def pieces(size: np.ndarray, most: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(which, number) of the pieces of at most `most` that each of `size` is cut into."""
    count = -(-size // most)
    which = np.repeat(np.arange(len(size)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def anchored_runs(data: np.ndarray, sizes: np.ndarray, cut: Cut) -> Runs:
    """The runs of all texts."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    none = np.zeros(0, np.int64)
    if len(data) < cut.length:
        return Runs(none, none, none, none.astype(np.uint64), starts)
    least = np.empty(len(data) - cut.length + 1, np.uint64)
    for at in range(0, len(least), _BLOCK):
        hashes = mix(rolling(data[at : at + _BLOCK + cut.length - 1], cut.anchor))
        least[at : at + _BLOCK] = _least(hashes, cut.length - cut.anchor + 1)
    change = np.empty(len(least), bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    # The last windows of a text reach over its end: they begin a run of their own, left out below.
    for edge in (starts, np.maximum(ends - cut.length + 1, starts)):
        change[edge[edge < len(least)]] = True
    first = np.flatnonzero(change)
    size = np.diff(np.append(first, len(least)))
    doc = np.searchsorted(ends, first, side="right")
    whole = first + cut.length <= ends[doc]
    first, size, doc = first[whole], size[whole], doc[whole]
    which, number = pieces(size, cut.run)
    first = first[which] + number * cut.run
    size = np.minimum(cut.run, size[which] - number * cut.run)
    return Runs(doc[which], first, size, least[first], starts)


def begins(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in ordered values."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def packed(values: np.ndarray, width: int) -> bytes:
    """Numbers as `width` bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching (first, end) as maximal ones, in order."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(runs: Runs, hot: np.ndarray, data: np.ndarray, cut: Cut) -> tuple[Runs, np.ndarray]:
    """(runs, part): what equal windows share. Runs of very common anchors come as single windows,
    dealt by a hash of their own, so that no part gets all that is around a common anchor."""
    part = runs.anchor.copy()
    if hot.any():
        which, number = pieces(runs.size, np.where(hot, 1, cut.run))
        single = hot[which]
        runs = Runs(
            runs.doc[which],
            runs.first[which] + np.where(single, number, 0),
            np.where(single, 1, runs.size[which]),
            runs.anchor[which],
            runs.starts,
        )
        part = part[which]
        part[single] = rolling(data, cut.length)[runs.first[single]]
    return runs, mix(part).view(np.int64)
