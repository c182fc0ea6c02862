"""Which runs of windows are repeats, which are not, and which need a closer look.

Runs of windows with one anchor (see `anchors`) are met by anchor, as plain
numbers in blocks of bounded size: a key of the anchor, a hash of the whole run
and the document. A run that a smaller document has too is a repeat as a whole;
so is decided, without moving any text, most of what is repeated. Only where
documents have different runs with one anchor, the smallest document's run of
each kind is needed itself, to compare its windows.

Exact up to hashes of 88 bits, which runs would have to share by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrid.llm.anchors import BASE, Cut, Runs, Symbols, anchored_runs, begins, packed, unpacked
from wiregrid.llm.common import batches_of, mix, parts_for, powers, text_bytes

#: What a mark says of a run: a repeat as a whole, one to compare, one to compare window by window.
WHOLE, OPEN, HOT = 1, 2, 3
#: A slice with more different runs of one anchor than this makes the anchor very common.
CROWD = 32
_KEY, _RUN = 5, 6  # bytes
_CROWDED = np.uint64((1 << 8 * _RUN) - 1)


def run_hashes(data: np.ndarray, runs: Runs, cut: Cut) -> np.ndarray:
    """A hash of all symbols of each run."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    end = runs.first + runs.size + cut.length - 1
    whole = (sums[end] - sums[runs.first]) * down[runs.first]
    return mix(whole + runs.size.astype(np.uint64) * BASE)


def _names(data: np.ndarray, runs: Runs, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spread anchor, key, hash) of each run; key and hash fit their bytes."""
    spread = mix(runs.anchor)
    hashes = run_hashes(data, runs, cut) >> np.uint64(64 - 8 * _RUN)
    return spread, spread >> np.uint64(64 - 8 * _KEY), np.minimum(hashes, _CROWDED - np.uint64(1))


def _codes(key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for key and hash; the two lowest bits are free for what a mark says."""
    return mix(key * BASE + hashes) & ~np.uint64(3)


def _rows(block: np.ndarray, columns: list[np.ndarray], widths: list[int], known: bool) -> list:
    """One row of plain numbers per block; inside it, they are in the order given."""
    order = np.argsort(block, kind="stable")
    edges = np.append(begins(block[order]), len(order))
    out = []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        part = order[x:y]
        out.append(
            (int(block[part[0]]), known,
             *[packed(c[part], w) for c, w in zip(columns, widths, strict=True)])
        )
    return out


def _blocks(texts: DataFrame, cut: Cut, symbols: Symbols, n_blocks: int) -> DataFrame:
    """Open runs (key, hash, doc) and known marks (mark, doc) of every slice, in blocks by anchor."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, found in batches_of(rows, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.uint64)
            data, sizes = symbols(found)
            runs = anchored_runs(data, sizes, cut)
            spread, key, hashes = _names(data, runs, cut)
            block = (spread % np.uint64(n_blocks)).astype(np.int64)
            doc = ids[runs.doc]
            order = np.lexsort((doc.view(np.int64), hashes, key, block))
            block, key, hashes, doc = block[order], key[order], hashes[order], doc[order]
            new_key = np.ones(len(key), bool)
            new_key[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            new_run = new_key.copy()
            new_run[1:] |= hashes[1:] != hashes[:-1]
            group = np.cumsum(new_key) - 1
            crowded = np.bincount(group, new_run)[group] > CROWD if len(group) else new_key
            holder = np.maximum.accumulate(np.where(new_run, np.arange(len(doc)), 0))
            whole = doc != doc[holder]
            own = new_run & ~crowded
            told = new_key & crowded
            codes = _codes(key, hashes)
            out = []
            for which, says in ((whole, WHOLE), (new_run & crowded, HOT)):
                marks = codes[which] | np.uint64(says)
                out += _rows(block[which], [marks, doc[which]], [8, 8], True)
            for which, named in ((own, hashes), (told, np.full(len(hashes), _CROWDED))):
                # By document, which compresses well.
                at = np.flatnonzero(which)
                at = at[np.argsort(doc[at], kind="stable")]
                out += _rows(block[at], [key[at], named[at], doc[at]], [_KEY, _RUN, 8], False)
            wide = [(b, k, *c, *([b""] * (3 - len(c)))) for b, k, *c in out]
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            names = ("block", "known", "a", "b", "c")
            columns = list(zip(*wide, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    return texts.mapInArrow(run, "block int, known boolean, a binary, b binary, c binary")


def _marks(blocks: DataFrame, cut: Cut) -> DataFrame:
    """(doc_id, marks): marks of a document's runs as plain numbers, several rows per document."""

    def run(table):
        import pyarrow as pa

        known = table.column("known").to_pylist()

        def joined(name: str, flag: bool, width: int) -> np.ndarray:
            values = table.column(name).to_pylist()
            return unpacked(b"".join(x for x, k in zip(values, known, strict=True) if k is flag), width)

        key, hashes = joined("a", False, _KEY), joined("b", False, _RUN)
        doc = joined("c", False, 8)
        order = np.lexsort((doc.view(np.int64), hashes, key))
        key, hashes, doc = key[order], hashes[order], doc[order]
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_run = new_key.copy()
        new_run[1:] |= hashes[1:] != hashes[:-1]
        group = np.cumsum(new_key) - 1
        holder = np.maximum.accumulate(np.where(new_run, np.arange(len(doc)), 0))
        crowd = hashes == _CROWDED
        says = np.zeros(len(doc), np.uint64)
        if len(doc):
            kinds = np.bincount(group, new_run)[group]
            first = doc[np.flatnonzero(new_key)][group]
            several = np.bincount(group, doc != first)[group] > 0
            common = (kinds > cut.hot) | (np.bincount(group, crowd)[group] > 0)
            says[(kinds > 1) & several] = OPEN
            says[common] = HOT
            says[doc != doc[holder]] = WHOLE
            says[crowd] = 0
        told = says > 0
        marks = np.concatenate((_codes(key, hashes)[told] | says[told], joined("a", True, 8)))
        doc = np.concatenate((doc[told], joined("b", True, 8))).view(np.int64)
        order = np.argsort(doc, kind="stable")
        marks, doc = marks[order], doc[order]
        edges = np.append(begins(doc), len(doc))
        lists = [
            marks[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
        ]
        return pa.table(
            {"doc_id": pa.array(doc[edges[:-1]], pa.int64()), "marks": pa.array(lists, pa.binary())}
        )

    return blocks.groupBy("block").applyInArrow(run, "doc_id long, marks binary")


def marked_texts(texts: DataFrame, cut: Cut, symbols: Symbols) -> DataFrame:
    """`texts` (doc_id, text) that have marked runs, with these as `marks`."""
    blocks = _blocks(texts, cut, symbols, parts_for(text_bytes(texts), cut.block))
    marks = _marks(blocks, cut).groupBy("doc_id").agg(F.collect_list("marks").alias("marks"))
    # Most documents have some mark, so the texts are met by a merge.
    return texts.join(marks.hint("merge"), "doc_id")


def said_of_runs(batch, data: np.ndarray, sizes: np.ndarray, cut: Cut) -> tuple[Runs, np.ndarray]:
    """The marked runs of a batch of marked texts, and what their marks say."""
    runs = anchored_runs(data, sizes, cut)
    _, key, hashes = _names(data, runs, cut)
    lists = [np.frombuffer(b"".join(x), np.uint64) for x in batch.column("marks").to_pylist()]
    of = np.repeat(np.arange(len(lists), dtype=np.uint64), [len(x) for x in lists])
    marks = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    says = marks & np.uint64(3)
    wanted = mix((marks & ~np.uint64(3)) + of * BASE)
    order = np.lexsort((says, wanted))
    wanted, says = wanted[order], says[order]
    have = mix(_codes(key, hashes) + runs.doc.astype(np.uint64) * BASE)
    at = np.searchsorted(wanted, have)
    hit = at < len(wanted)
    hit[hit] = wanted[at[hit]] == have[hit]
    return runs.take(hit), says[at[hit]]
