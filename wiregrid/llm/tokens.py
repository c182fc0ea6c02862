"""Token ids of whole texts by the tokenizers library, each distinct stretch encoded once.

A tokenizer's own pre-tokenizer never joins what this module splits, so the ids
of a text are those of its stretches in order. Stretches repeat (they are words,
mostly), so a worker keeps the ids of those it has met, up to a bound. The name of
a special token inside a text is that token, as in the library's plain call, unless
the encoder is told otherwise.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

#: White space as the tokenizers' patterns know it.
_WHITE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: Of a run of white space the last character is apart, and a last blank belongs to what follows.
_STRETCH = re.compile(f"[{_WHITE}]+(?![^{_WHITE}])| ?[^{_WHITE}]+|[{_WHITE}]")
_WORD = re.compile(f"[^{_WHITE}]+")
#: What a text with single blanks and line ends only does not have.
_ODD = ["  ", "\n\n", " \n", "\n ", "\0", *(c for c in _WHITE if c not in " \n")]
#: What str.split() also takes for white space.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def keeps_white(text: str) -> list[str]:
    """Stretches for a vocabulary that keeps white space."""
    if text[:1] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD):
        return _STRETCH.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def drops_white(text: str) -> list[str]:
    """Stretches for a vocabulary that drops white space."""
    if any(x in text for x in _SEPARATORS):
        return _WORD.findall(text)
    return text.split()


class Encoder:
    """Ids of many texts at once. `most` bounds the characters of the stretches kept.

    Without `special`, the name of a special token inside a text is text like any other.
    """

    def __init__(
        self,
        path: str,
        split: Callable[[str], list[str]],
        most: int = 12_000_000,
        special: bool = True,
    ):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        known = self.tokenizer.get_added_tokens_decoder().values() if special else ()
        names = [t.content for t in known]
        self.named = re.compile("(" + "|".join(map(re.escape, sorted(names, key=len)[::-1])) + ")")
        self.names, self.plain, self.most = names, split, most
        self._clear()

    def split(self, text: str) -> list[str]:
        """Stretches of a text; the name of a special token is one, apart from what is around it."""
        if not any(name in text for name in self.names):
            return self.plain(text)
        parts = self.named.split(text)
        return [x for i, p in enumerate(parts) if p for x in ([p] if i % 2 else self.plain(p))]

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.held = 0

    def _lists(self, stretches: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)
        return [x.ids for x in found]

    def _learn(self, stretches: list[str]) -> None:
        lists = self._lists(stretches)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.code.update(zip(stretches, range(len(self.code), len(self.code) + len(lists)),
                             strict=True))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        self.ids = np.concatenate((self.ids, flat))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))
        self.held += sum(map(len, stretches))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, ids of each text)."""
        if self.held > self.most:
            self._clear()
        split = list(map(self.split, texts))
        flat = list(chain.from_iterable(split))
        codes = np.fromiter(map(self.code.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            missing = [flat[i] for i in unknown]
            self._learn(sorted(set(missing)))
            codes[unknown] = list(map(self.code.__getitem__, missing))
        sizes = (self.first[1:] - self.first[:-1])[codes]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        ids = self.ids[places + np.repeat(self.first[codes], sizes)]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        upto = np.concatenate(([0], ends))[np.cumsum(counts)] if len(counts) else counts
        return ids, np.diff(np.concatenate(([0], upto)))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, split: Callable[[str], list[str]]) -> Encoder:
    """The encoder of this worker."""
    key = (path, split.__name__)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, split)
    return _ENCODERS[key]


def encode_ended(worker: Encoder, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, first place of each text and the end): every text's ids and then the id `end`."""
    ids, sizes = worker.encode([x.decode("utf-8", "replace") for x in texts])
    out = np.full(len(ids) + len(texts), end, np.uint32)
    stops = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(out), bool)
    inner[stops] = False
    out[inner] = ids
    return out, np.concatenate(([0], stops + 1))
