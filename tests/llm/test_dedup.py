"""Exact and near duplicates, repeated passages and byte strings."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from wiregrid.llm import common, debruijn, exact_radix, minhash_fss, suffix_bcr
from wiregrid.llm.anchors import Cut
from wiregrid.llm.common import Words, components
from wiregrid.session import materialize


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("first", [1, 48])
def test_exact_groups(nulls, first):
    found = exact_radix.groups(nulls, first=first).collect()
    got = [(r.doc_id, r.keep_id, r.group_size, r.doc_id == r.keep_id, r.text_sha256) for r in found]
    assert ordered(got) == ordered(brute.exact(pairs(nulls)))


def test_exact_columns_and_empty(empty):
    found = exact_radix.deduplicate(empty)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found.count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_components(docs, width):
    found = minhash_fss.near_components(docs, minhash_fss.Near(width=width)).collect()
    expected = brute.near(pairs(docs), width)
    assert ordered(found) == ordered(expected)
    assert len({r[2] for r in expected}) < len({r[0] for r in expected}) - 10


def test_near_chain(spark):
    """Each text resembles the next one only, so links lead through the whole chain."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[9 * i : 9 * i + 100])) for i in range(30)]
    docs = spark.createDataFrame(random.Random(1).sample(rows, 30), "doc_id long, text string")
    found = minhash_fss.near_components(docs, minhash_fss.Near(width=2)).collect()
    assert ordered(found) == ordered(brute.near(rows, 2))
    assert {r.component_id for r in found} == {0}


def test_near_copies_just_too_unlike_are_not_all_compared(spark, monkeypatch):
    draw = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in draw.sample(range(120), draw.choice((2, 3, 4, 9, 10, 11))):
            words[at] = f"x{draw.randrange(200)}"
        rows.append((i, " ".join(words)))
    compared = []

    def seen(df, label, *metrics, **how):
        table, found = materialize(df, label, *metrics, **how)
        if label == "near-pairs":
            compared.append(found["rows"])
        return table, found

    monkeypatch.setattr(minhash_fss, "materialize", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash_fss.near_components(docs, minhash_fss.Near(width=2)).collect()
    assert ordered(found) == ordered(brute.near(rows, 2))
    assert sum(compared) < 40 * len(rows)


def test_stored_tables_are_broadcast_by_their_rows(spark, monkeypatch):
    """By their files, all of these tables are small."""
    draw, rows = random.Random(9), []
    for i in range(300):
        words = [f"w{i % 6}x{k}" for k in range(60)]
        for at in draw.sample(range(60), draw.choice((0, 1, 2, 5, 6))):
            words[at] = f"y{draw.randrange(100)}"
        rows.append((i, " ".join(words)))
    plans = []

    def seen(df, label, *metrics, **how):
        plan = df._jdf.queryExecution().executedPlan().toString()
        plans.append((label, "BroadcastHashJoin" in plan))
        return materialize(df, label, *metrics, **how)

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(common, "materialize", seen)
    monkeypatch.setattr(minhash_fss, "materialize", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash_fss.near_components(docs, minhash_fss.Near(width=2)).collect()
    assert ordered(found) == ordered(brute.near(rows, 2))
    assert {"near-pairs", "near-open", "near-state", "near-hooks"} <= {label for label, _ in plans}
    # Sets do not pack; Spark takes a join for as large as the product of its sides; frequent shingles are counted.
    assert {label for label, met in plans if met} <= {"near-sets", "near-links", "near-left", "near-rarest"}


def test_near_empty(empty, nulls):
    assert minhash_fss.near_components(empty).count() == 0
    lost = minhash_fss.near_components(nulls).where("doc_id IS NULL").collect()
    assert [tuple(r) for r in lost] == [(None, 0, None)] * 3


def test_sketch_fills_every_coordinate():
    sets = [np.arange(n, dtype=np.uint64) + np.uint64(7) for n in (0, 1, 2, 50, 3000)]
    bins = minhash_fss.sketch(sets, 160)
    assert (bins[0] == np.uint64(2**64 - 1)).all() and (bins[1:] != np.uint64(2**64 - 1)).all()


def test_sketch_tells_similarity():
    draw = np.random.default_rng(5)
    common = draw.integers(0, 2**63, 800).astype(np.uint64)
    other = draw.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.concatenate((common, other[:200])), np.concatenate((common, other[200:]))]
    bins = minhash_fss.sketch(sets, 2000)
    assert abs((bins[0] == bins[1]).mean() - 800 / 1200) < 0.05


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(60)]
    links += [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (5, None), (200, 200)]
    root = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in root and b in root and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == root


def test_byte_repeats(docs):
    found = suffix_bcr.cut_repeats(docs)
    assert set(docs.columns) <= set(found.columns)
    got = [
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
        for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    ]
    assert ordered(got) == ordered(brute.byte_repeats(pairs(docs)))


@pytest.mark.parametrize(
    "cut", [Cut(length=12, anchor=4, hot=1, part=400, block=500), Cut(length=9, anchor=9, run=2)]
)
def test_byte_repeats_in_many_parts(nulls, cut):
    """Very common anchors, many parts, short runs."""
    got = [
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
        for r in suffix_bcr.cut_repeats(nulls, cut)
        .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    ]
    assert ordered(got) == ordered(brute.byte_repeats(pairs(nulls), cut.length))


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.text("ab\0", min_size=5, max_size=24), min_size=1, max_size=12, unique=True),
    st.integers(2, 5),
)
def test_columns_sort_all_suffixes(strings, length):
    texts = [s.encode() for s in strings]
    holder = np.arange(len(texts)) * 7 % 5
    found = suffix_bcr.repeated_windows(texts, holder, length)
    least = {}
    for t, h in zip(texts, holder, strict=True):
        for i in range(len(t) - length + 1):
            least[t[i : i + length]] = min(least.get(t[i : i + length], h), h)
    for t, h, places in zip(texts, holder, found, strict=True):
        wanted = [i for i in range(len(t) - length + 1) if least[t[i : i + length]] < h]
        assert places.tolist() == wanted


def test_only_strings_that_share_a_window_enter_the_columns(monkeypatch):
    """The work of a part follows what is repeated in it, not all that has a common anchor."""
    draw, built = random.Random(11), []

    def text(n):
        return bytes(draw.randrange(97, 123) for _ in range(n))

    strings = [text(30) + b"a common anchor " + text(30) for _ in range(300)]
    strings[7] = strings[4][:55] + text(21)
    strings[9] = b"ab" * 40  # repeats windows of its own only
    strings[11] = text(20)  # without any window

    class Counted(suffix_bcr.Columns):
        def __init__(self, strings, most):
            built.append(len(strings))
            super().__init__(strings, most)

    monkeypatch.setattr(suffix_bcr, "Columns", Counted)
    found = suffix_bcr.repeated_windows(strings, np.arange(300), 50)
    assert {k: p.tolist() for k, p in enumerate(found) if len(p)} == {7: [0, 1, 2, 3, 4, 5]}
    assert sum(built) <= 3


def test_common_prefixes():
    strings = [b"banana", b"bandana", b"anana", b"nan"]
    columns = suffix_bcr.Columns(strings, 4)
    suffixes = sorted(
        ((s[i:], k) for k, s in enumerate(strings) for i in range(len(s) + 1)),
        key=lambda x: (x[0] + b"\0" * 0, x[1]),
    )

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b), 4) and a[n] == b[n]:
            n += 1
        return n

    lengths = [0] + [
        shared(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)
    ]
    assert columns.common.tolist() == lengths


def test_word_repeats(docs):
    found = debruijn.cut_repeats(docs).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in found]
    expected = brute.word_repeats(pairs(docs))
    assert ordered(got) == ordered(expected)
    assert sum(r[2] for r in expected) > 1000


@pytest.mark.parametrize(
    "cut", [Cut(length=6, anchor=2, hot=1, block=500), Cut(length=4, anchor=3, run=3)]
)
def test_word_repeats_in_many_parts(nulls, cut):
    got = [
        (r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode())
        for r in debruijn.cut_repeats(nulls, cut).collect()
    ]
    assert ordered(got) == ordered(brute.word_repeats(pairs(nulls), cut.length))


def test_repeats_of_nothing(empty):
    assert suffix_bcr.cut_repeats(empty).count() == 0
    assert debruijn.cut_repeats(empty).count() == 0


def thue_morse(n):
    """Two words of n letters that every polynomial hash modulo 2**64 takes for one another."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in ones), "".join("ba"[b] for b in ones)


def test_word_hashes_follow_places_not_a_polynomial():
    left, right = thue_morse(4096)
    odd = ["ab", "ba", "abba", "baab", "aab", "a", "b", "aa", left, right, left[:1024], right[:1024]]
    words = Words([" ".join(odd).encode(), b"", " ".join(odd).encode()])
    assert len(set(words.hash[: len(odd)].tolist())) == len(odd)
    assert np.array_equal(words.hash[: len(odd)], words.hash[len(odd) :])


def test_words_of_one_polynomial_hash_are_different_words(spark):
    left, right = thue_morse(1024)
    before, after = [f"u{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(1, " ".join([*before, left, *after])), (2, " ".join([*before, right, *after])), (3, left), (4, right)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in debruijn.cut_repeats(made).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    found = minhash_fss.near_components(made.where("doc_id > 2"), minhash_fss.Near(width=2))
    assert {r.doc_id: r.component_id for r in found.collect()} == {3: 3, 4: 4}
