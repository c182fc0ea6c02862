"""Alignment of two tokenizers over the same texts by divide and conquer at shared cuts.

Both tokenizers cut the bytes of a text (with a blank in front) into tokens. A
place where a token of each ends is a shared cut. An interval between two cuts
is divided at a common end near its middle: the end of its middle token of A is
looked up among the ends of B by bisection, then those of the tokens next to it,
further and further out. Both halves are divided again. An interval in which no
end is shared is a group. All intervals of one depth of a slice of texts are
divided together.

The tokens of a group are linked, each of A with each of B. A slice of texts
sends one row with its distinct linked id pairs and in how many of its
documents each is, so that counting over all documents shuffles a pair once
per slice, however many documents hold it; the counts come back to the slice the
same way, and meet its documents' links by number.

Defined results: texts that are null or empty, and those whose tokens do not
give back their bytes (such as texts with a mark U+2581, for a vocabulary that
writes blanks so), have no tokens, zeros and empty groups. Strings of special
tokens are plain text. A row is a document, also if rows share a doc_id or
texts are equal. Very long texts are slices of their own. Further columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrid.llm.common import batches_of
from wiregrid.llm.tokens import Encoder, keeps_white
from wiregrid.session import materialize

MARK = "▁"
#: Groups with more links than this are linked by their distinct ids.
WIDE = 4096


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The bytes of every id, and the ids and byte ends of many texts."""

    def __init__(self, worker: Encoder, bytes_of: list[bytes]):
        self.worker = worker
        self.size = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(bytes_of), np.uint8)
        #: Decimal ids with what may follow them.
        self.names = {
            mark: np.array([f"{i}{mark}" for i in range(len(bytes_of))], object)
            for mark in (",", "|", ";", "")
        }

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.worker.encode(texts)

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens one after another."""
        size = self.size[ids]
        ends = np.cumsum(size)
        places = np.arange(ends[-1] if len(ends) else 0)
        return self.data[places + np.repeat(self.first[ids] - ends + size, size)].tobytes()


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary; texts come with their blank in front."""
    worker = Encoder(path, keeps_white, special=False)
    byte = _byte_of()
    entries = worker.tokenizer.get_vocab(with_added_tokens=True)
    bytes_of = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        if all(c in byte for c in entry):
            bytes_of[i] = bytes(byte[c] for c in entry)
    return Vocabulary(worker, bytes_of)


class _Pieces(Encoder):
    """Ids by a SentencePiece model, which puts the blank in front itself."""

    def __init__(self, path: str, most: int = 12_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        # Where no piece has a blank after another character, none crosses the start of a word.
        apart = not any(re.search(f"[^{MARK}]{MARK}", name) for name in names)
        self.blank = self.model.piece_to_id(MARK)
        self.split, self.most = (marked_words if apart else whole_text), most
        self._clear()

    def _lists(self, stretches: list[str]) -> list[list[int]]:
        found = self.model.encode([x[1:] for x in stretches], num_threads=1)
        return [ids if x != " " else [self.blank] for x, ids in zip(stretches, found, strict=True)]


def marked_words(text: str) -> list[str]:
    """Blanks and what follows them, the text's own blank in front."""
    whole = " " + text
    if "  " in whole or whole[-1] == " " or "\0" in whole:
        return re.findall(" *[^ ]+| +", whole)
    return whole.replace(" ", "\0 ").split("\0")[1:]


def whole_text(text: str) -> list[str]:
    return [" " + text]


def pieces(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model; its blank in front comes by itself."""
    worker = _Pieces(path)
    model = worker.model
    bytes_of = []
    for i in range(model.vocab_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_of.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            bytes_of.append(b"")
        else:
            bytes_of.append(name.replace(MARK, " ").encode())
    return Vocabulary(worker, bytes_of)


_KNOWN: dict[tuple, Vocabulary] = {}


def vocabulary(make, path: str) -> Vocabulary:
    """The vocabulary of this worker."""
    key = (make.__name__, path)
    if key not in _KNOWN:
        _KNOWN[key] = make(path)
    return _KNOWN[key]


@dataclass
class Intervals:
    """Token ranges of A and of B that cover the same bytes: first ones, and those after the last."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def take(self, which: np.ndarray) -> Intervals:
        return Intervals(self.a[which], self.a_end[which], self.b[which], self.b_end[which])

    def __len__(self) -> int:
        return len(self.a)


def _middle_cuts(ends_a, ends_b, open_: Intervals) -> tuple[np.ndarray, np.ndarray]:
    """Per interval the tokens of A and B before the common end nearest its middle; -1 if none."""
    cut_a, cut_b = np.full(len(open_), -1), np.full(len(open_), -1)
    middle = (open_.a + open_.a_end - 2) // 2
    # The end of an interval's last token is its own end, no cut inside it.
    left = np.flatnonzero((open_.a_end - open_.a > 1) & (open_.b_end - open_.b > 1))
    out = 0
    while len(left):
        for at in (middle[left] + out, middle[left] - out) if out else (middle[left],):
            inside = (at >= open_.a[left]) & (at <= open_.a_end[left] - 2)
            value = ends_a[np.where(inside, at, 0)]
            place = np.searchsorted(ends_b, value)
            hit = inside & (cut_a[left] < 0)
            hit &= ends_b[np.minimum(place, len(ends_b) - 1)] == value
            cut_a[left[hit]], cut_b[left[hit]] = at[hit], place[hit]
        out += 1
        more = (middle[left] - out >= open_.a[left]) | (middle[left] + out <= open_.a_end[left] - 2)
        left = left[(cut_a[left] < 0) & more]
    return cut_a, cut_b


def groups(ends_a: np.ndarray, ends_b: np.ndarray, texts: Intervals) -> Intervals:
    """The groups of all texts in order. Ends are byte places that rise over all texts."""
    leaves, open_ = [], texts
    while len(open_):
        cut_a, cut_b = _middle_cuts(ends_a, ends_b, open_)
        leaves.append(open_.take(np.flatnonzero(cut_a < 0)))
        which = np.flatnonzero(cut_a >= 0)
        some, cut_a, cut_b = open_.take(which), cut_a[which] + 1, cut_b[which] + 1
        open_ = Intervals(
            np.concatenate((some.a, cut_a)), np.concatenate((cut_a, some.a_end)),
            np.concatenate((some.b, cut_b)), np.concatenate((cut_b, some.b_end)),
        )
    if not leaves:
        return texts
    found = Intervals(
        *[np.concatenate([getattr(x, c) for x in leaves]) for c in ("a", "a_end", "b", "b_end")]
    )
    return found.take(np.argsort(found.a, kind="stable"))


def links(
    ids_a: np.ndarray, ids_b: np.ndarray, found: Intervals
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of every linked pair; a pair is A's id in the high half, B's in the low."""
    n_a, n_b = found.a_end - found.a, found.b_end - found.b
    narrow = np.flatnonzero(n_a * n_b <= WIDE)
    size = (n_a * n_b)[narrow]
    group = np.repeat(narrow, size)
    number = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    first = ids_a[found.a[group] + number // n_b[group]].astype(np.int64)
    pair = (first << 32) | ids_b[found.b[group] + number % n_b[group]].astype(np.int64)
    out = [(group, pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(n_a * n_b > WIDE):
        a, times_a = np.unique(ids_a[found.a[g] : found.a_end[g]], return_counts=True)
        b, times_b = np.unique(ids_b[found.b[g] : found.b_end[g]], return_counts=True)
        wide = ((a.astype(np.int64) << 32)[:, None] | b.astype(np.int64)).ravel()
        out.append((np.full(len(wide), g), wide, np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def spelled(
    side_a: Vocabulary, side_b: Vocabulary, ids_a: np.ndarray, ids_b: np.ndarray,
    found: Intervals, texts: Intervals,
) -> list[str]:
    """Per text its groups as `a1,a2|b1;a3|b2,b3`."""
    n_a, n_b = found.a_end - found.a, found.b_end - found.b
    # The tokens of B in a group come after those of A in it, and before the next group.
    before = np.cumsum(n_a + n_b) - n_a - n_b
    at_a = np.arange(len(ids_a)) + np.repeat(before - found.a, n_a)
    at_b = np.arange(len(ids_b)) + np.repeat(before + n_a - found.b, n_b)
    words = np.empty(len(ids_a) + len(ids_b), object)
    words[at_a] = side_a.names[","][ids_a]
    words[at_b] = side_b.names[","][ids_b]
    words[before + n_a - 1] = side_a.names["|"][ids_a[found.a_end - 1]]
    words[before + n_a + n_b - 1] = side_b.names[";"][ids_b[found.b_end - 1]]
    ends = texts.a_end + texts.b_end
    words[ends - 1] = side_b.names[""][ids_b[texts.b_end - 1]]
    words = words.tolist()
    starts = (texts.a + texts.b).tolist()
    return ["".join(words[x:y]) for x, y in zip(starts, ends.tolist(), strict=True)]


def _faithful(side: Vocabulary, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the tokens of each text give back its bytes with a blank in front."""
    data = side.joined(ids)
    upto = np.concatenate(([0], np.cumsum(side.size[ids])))[np.concatenate(([0], np.cumsum(counts)))]
    return np.array(
        [data[x:y] == b" " + t for x, y, t in zip(upto[:-1], upto[1:], texts, strict=True)], bool
    )


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    return ends - counts, ends


@dataclass
class Aligned:
    """What a slice of texts gives; texts without tokens have zeros."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    #: Distinct pairs of the slice, and how many of its texts have each linked.
    pairs: np.ndarray
    texts: np.ndarray
    #: Per text the numbers of its pairs among these, and how often each is linked.
    numbers: list[np.ndarray]
    times: list[np.ndarray]


def align_texts(side_a: Vocabulary, side_b: Vocabulary, raw: list[bytes]) -> Aligned:
    """The alignment of some texts."""
    total = len(raw)
    texts = [x.decode("utf-8", "replace") for x in raw]
    whole = np.array([len(x) > 0 for x in raw], bool)
    sides = []
    for side, shown in ((side_a, [" " + t for t in texts]), (side_b, texts)):
        ids, counts = side.encode(shown)
        whole &= _faithful(side, ids, counts, raw)
        sides.append((ids, counts))
    for k, (ids, counts) in enumerate(sides):
        sides[k] = ids[np.repeat(whole, counts)], counts[whole]
    (ids_a, n_a), (ids_b, n_b) = sides
    parts = Intervals(*_ranges(n_a), *_ranges(n_b))
    found = groups(np.cumsum(side_a.size[ids_a]), np.cumsum(side_b.size[ids_b]), parts)
    text_of = np.searchsorted(parts.a_end, found.a, side="right")
    group, pair, times = links(ids_a, ids_b, found)
    pairs, number = np.unique(pair, return_inverse=True)
    key = text_of[group] * max(len(pairs), 1) + number
    keys, place = np.unique(key, return_inverse=True)
    # Whole numbers, added exactly also where a text has very many equal links.
    held = np.zeros(len(keys), np.int64)
    np.add.at(held, place, times)
    owner, number = keys // max(len(pairs), 1), keys % max(len(pairs), 1)
    cuts = np.searchsorted(owner, np.arange(len(n_a) + 1))

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(total, np.int64)
        out[whole] = values
        return out

    count = len(n_a)
    n_links = np.zeros(count, np.int64)
    np.add.at(n_links, owner, held)
    listed = iter(spelled(side_a, side_b, ids_a, ids_b, found, parts))
    where = iter(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    ranges = [next(where) if ok else (0, 0) for ok in whole]
    return Aligned(
        spread(n_a), spread(n_b), spread(np.bincount(text_of, minlength=count)), spread(n_links),
        [next(listed) if ok else "" for ok in whole],
        pairs, np.bincount(number, minlength=len(pairs)),
        [number[x:y] for x, y in ranges], [held[x:y] for x, y in ranges],
    )


_SLICE = (
    "kind string, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups string, groups_sha256 string, numbers binary, times binary, "
    "pairs array<long>, texts array<long>"
)
_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups string, groups_sha256 string"
)


def _arrow(names_types: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(),
             "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in names_types.split(", "))])


def _slices(
    rows: Iterator[pa.RecordBatch], path_a: str, path_b: str, with_groups: bool
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    side_a, side_b = vocabulary(byte_level, path_a), vocabulary(pieces, path_b)
    schema = _arrow(_SLICE)
    first = TaskContext.get().partitionId() << 32
    for i, (batch, raw) in enumerate(batches_of(rows, "text")):
        got = align_texts(side_a, side_b, raw)
        n = len(raw)
        digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in got.groups]
        columns = {
            "kind": ["text"] * n + ["pairs"],
            "chunk": [first + i] * (n + 1),
            "doc_id": [*batch.column("doc_id").to_pylist(), None],
            "n_a": [*got.n_a.tolist(), None],
            "n_b": [*got.n_b.tolist(), None],
            "n_groups": [*got.n_groups.tolist(), None],
            "n_links": [*got.n_links.tolist(), None],
            "groups": [*(got.groups if with_groups else [None] * n), None],
            "groups_sha256": [*digests, None],
            "numbers": [*(x.astype("<u4").tobytes() for x in got.numbers), None],
            "times": [*(x.astype("<u8").tobytes() for x in got.times), None],
            "pairs": [None] * n + [got.pairs],
            "texts": [None] * n + [got.texts],
        }
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) for f in schema], schema=schema
        )


def _answered(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a slice with the counts of its pairs."""
    number = right.column("number").to_numpy()
    count = np.zeros(len(number), np.int64)
    best = np.zeros(len(number), bool)
    count[number] = right.column("count").to_numpy()
    best[number] = right.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for numbers, times in zip(
        left.column("numbers").to_pylist(), left.column("times").to_pylist(), strict=True
    ):
        which = np.frombuffer(numbers, "<u4")
        often = np.frombuffer(times, "<u8").astype(np.int64)
        n_best.append(int(often[best[which]].sum()))
        count_sum.append(int((often * count[which]).sum()))
    schema = _arrow(_ALIGNED)
    new = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table([new.get(f.name, None) if f.name in new else left.column(f.name).cast(f.type)
                     for f in schema], schema=schema)


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Every document of `docs` (doc_id, text) with its alignment.

    doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (if asked for, else null) and
    groups_sha256. `path_a` is a byte-level vocabulary, `path_b` a SentencePiece model.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(rows: Iterator) -> Iterator:
        return _slices(rows, path_a, path_b, with_groups)

    table, _ = materialize(texts.mapInArrow(run, _SLICE), "aligned", partition_by=["kind"])
    spots = table.where("kind = 'pairs'").select(
        F.col("chunk").alias("slice"), F.posexplode(F.arrays_zip("pairs", "texts")).alias("number", "x")
    ).select("slice", "number", "x.pairs", "x.texts")
    counts, _ = materialize(
        spots.groupBy("pairs").agg(F.sum("texts").alias("count")), "pair-counts"
    )
    counts = counts.withColumn("a", F.shiftright("pairs", 32))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    told = counts.join(best, "a").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = spots.join(told, "pairs").select("slice", "number", "count", "best")
    held = table.where("kind = 'text'").drop("kind", "pairs", "texts")
    return (
        held.groupBy("chunk").cogroup(answers.groupBy("slice")).applyInArrow(_answered, _ALIGNED)
    )
