"""Encoding and decoding with a SentencePiece vocabulary by a shared-prefix Viterbi search.

Blanks become marks, a mark is put in front, and the text falls into marked
words, which no piece crosses. The distinct words of a slice are sorted, which
is the depth-first order of their trie, and searched with a stack of forward
states, one per character: a word starts from the states of the prefix it has
in common with the word before.

The vocabulary is one of merges: pieces are joined in the order of their
scores. A sequence of pieces is the result of merging exactly if this holds for
every two neighbours, so the forward score of a transition is 0 if the two
pieces stay apart and minus infinity if merging would have joined across them.
One path is left per prefix, and its last piece is the state. Whether a pair
stays apart is found by undoing the merges of both, last first, and is kept.

Characters without a piece are written as bytes.

Defined results: null and empty texts have no ids. A mark in a text is a blank
after decoding, as for the model itself. Rows that share a doc_id are rows of
their own. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from wiregrid.llm.common import batches_of
from wiregrid.llm.tokens import Encoder

MARK = "▁"


class Vocabulary:
    """Pieces and scores of a model file, and which pairs of pieces stay apart."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.id = {
            name: i
            for i, name in enumerate(names)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        }
        self.score = {name: model.get_score(i) for name, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        self.bytes_of = [n.encode() for n in names]
        for value, i in self.byte.items():
            self.bytes_of[i] = bytes([value])
        for i in range(size):
            if model.is_control(i) or model.is_unknown(i):
                self.bytes_of[i] = b""
        if any(MARK in name.lstrip(MARK) or "\n" in name for name in self.id):
            raise ValueError("pieces cross words: this vocabulary cannot be split at marks")
        self._halves: dict[str, tuple[str, str] | None] = {}
        self._apart: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short text by merging, and the two that were merged last."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """What a piece is merged from; None for a character or a piece merging never makes."""
        if piece not in self._halves:
            parts, last = self.merged(piece)
            self._halves[piece] = last if parts == [piece] else None
        return self._halves[piece]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging `left` + `right` ends with these two."""
        key = (left, right)
        if key not in self._apart:
            if MARK * 2 in left + right:
                # Pieces of marks have equal scores: merge them out.
                self._apart[key] = self.merged(left + right)[0] == [left, right]
            else:
                self._apart[key] = self._undone(left, right)
        return self._apart[key]

    def _undone(self, left: str, right: str) -> bool:
        floor, strict = float("-inf"), False
        while True:
            joint = self.score.get(left + right)
            if joint is not None and (joint > floor or (joint == floor and strict)):
                return False
            if len(left) == len(right) == 1:
                return True
            # The merge with the lower score was the later one; of equal ones the right one.
            first = self.score.get(left, float("inf")) if len(left) > 1 else float("inf")
            second = self.score.get(right, float("inf")) if len(right) > 1 else float("inf")
            if first < second:
                floor, strict, left = first, False, self.halves(left)[1]
            else:
                floor, strict, right = second, True, self.halves(right)[0]

    def made(self, piece: str) -> bool:
        """Whether merging can end with this piece."""
        return len(piece) == 1 or (piece in self.id and self.halves(piece) is not None)

    def ids(self, piece: str) -> list[int]:
        found = self.id.get(piece)
        return [self.byte[b] for b in piece.encode()] if found is None else [found]


def search(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of sorted distinct words: a depth-first walk of their trie."""
    apart, made, longest = vocabulary.apart, vocabulary.made, vocabulary.longest
    known = vocabulary.id
    states: list[str] = [""]  # the last piece of every prefix of the word at hand
    before, out = "", []
    for word in words:
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del states[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                piece = word[start:end]
                if (end - start > 1 and piece not in known) or not made(piece):
                    continue
                if start == 0 or apart(states[start], piece):
                    states.append(piece)
                    break
        found, end = [], len(word)
        while end:
            found.append(states[end])
            end -= len(states[end])
        out.append([i for piece in reversed(found) for i in vocabulary.ids(piece)])
        before = word
    return out


_WORDS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def marked_words(text: str) -> list[str]:
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


class PieceEncoder(Encoder):
    """Ids of many texts at once; see Encoder for what it keeps."""

    def __init__(self, path: str, most: int = 8_000_000):
        self.vocabulary = Vocabulary(path)
        self.split, self.most = marked_words, most
        self._clear()

    def _lists(self, stretches: list[str]) -> list[list[int]]:
        return search(stretches, self.vocabulary)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes are joined to characters, marks are blanks, the first one goes."""
        of = self.vocabulary.bytes_of
        text = b"".join([of[i] for i in ids.tolist()]).decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every whole text of `docs` (doc_id, text)."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        worker = encoder(model)
        for batch, texts in batches_of(rows, "text"):
            ids, sizes = worker.encode([x.decode("utf-8", "replace") for x in texts])
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))],
                names=["doc_id", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_sha256, n_chars): digests of the ids and the text they say.

    The crc is of the ids as unsigned little-endian 32-bit numbers.
    """

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        worker = encoder(model)
        for batch in rows:
            columns: list[list] = [[], [], [], []]
            for found in batch.column("ids"):
                ids = found.values.to_numpy(zero_copy_only=False)
                text = worker.decode(ids)
                raw = ids.astype("<u4").tobytes()
                row = (
                    len(ids), zlib.crc32(raw), hashlib.sha256(text.encode()).hexdigest(), len(text)
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_tokens", "ids_crc32", "text_sha256", "n_chars"],
            )

    return encoded.mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, text_sha256 string, n_chars long"
    )
