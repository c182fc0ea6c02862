"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def exact(rows):
    """rows: (doc_id, text)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub(" ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, sha(text)) for i in ids]
    return out


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near(rows, width):
    sets = [(d, shingles(t, width)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and a is not None and b is not None:
                if 100 * len(x & y) >= 80 * len(x | y):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return [(d, len(s), find(d)) for d, s in sets]


def marked(rows, length):
    """rows: (doc_id, symbols); a list of covered symbols for each."""
    first = {}
    for d, s in rows:
        if d is not None:
            for i in range(len(s) - length + 1):
                w = tuple(s[i : i + length])
                first[w] = min(first.get(w, d), d)
    out = []
    for d, s in rows:
        cover = [False] * len(s)
        if d is not None:
            for i in range(len(s) - length + 1):
                if first[tuple(s[i : i + length])] < d:
                    cover[i : i + length] = [True] * length
        out.append(cover)
    return out


def byte_repeats(rows, length=50):
    texts = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for (d, t), cover in zip(texts, marked(texts, length), strict=True):
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        spans = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((d, len(t), sum(cover), spans, kept))
    return out


def word_repeats(rows, length=50):
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    return [
        (d, len(w), sum(cover), " ".join(x for x, c in zip(w, cover, strict=True) if not c))
        for (d, w), cover in zip(texts, marked(texts, length), strict=True)
    ]
