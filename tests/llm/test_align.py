"""The alignment against a plain merge of both tokenizers' ends."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose
from wiregrid.llm import queries, token_align

A = "byte_bpe_50k.json"
B = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """(ids, byte strings) of a text by both libraries, called on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(queries.tokenizer_path(A))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(B))
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown}
    byte |= {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        a_bytes = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
            else second.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        return a, a_bytes, b, b_bytes

    return tokens


def expected(texts, tokens):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    found = []
    for text in texts:
        groups = []
        if text:
            a, a_bytes, b, b_bytes = tokens(text)
            whole = b" " + text.encode()
            if b"".join(a_bytes) == whole == b"".join(b_bytes):
                ends_a = np.cumsum([len(x) for x in a_bytes]).tolist()
                ends_b = np.cumsum([len(x) for x in b_bytes]).tolist()
                shared = sorted(set(ends_a) & set(ends_b))
                start = 0
                for end in shared:
                    groups.append(
                        ([i for i, e in zip(a, ends_a, strict=True) if start < e <= end],
                         [i for i, e in zip(b, ends_b, strict=True) if start < e <= end])
                    )
                    start = end
        found.append(groups)
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for groups in found]
    count = Counter(pair for held in links for pair in held)
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for groups, held in zip(found, links, strict=True):
        line = ";".join(
            ",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups
        )
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups),
            sum(held.values()), sum(n for p, n in held.items() if count[p] == most[p[0]]),
            sum(n * count[p] for p, n in held.items()),
            hashlib.sha256(line.encode()).hexdigest() if line else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["x" * 700, "aaab" * 60, "é" * 90, "  lead", "tail ", "tail  ", "a▁b", "<|endoftext|>",
       "</s><s> <unk>", "line\n\n  two\r\n\tthree", "日本語のテスト", "0123456789" * 9, "🙂🙃 x",
       "  no break", "a\0b", "\x1c \x1f", "don't DON'T we'll", " ", "\n", "ſK"]


def test_alignment_equals_a_merge_of_ends(spark, rows, plain):
    texts = [r[1] for r in rows if r[1] is None or len(r[1]) < 6000]
    texts += [*ODD, *ODD[:4], prose(9, 900)]
    docs = spark.createDataFrame(
        [(i, t, "x", -1) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, n_a int"
    ).repartition(3)
    got = token_align.align(
        docs, queries.tokenizer_path(A), queries.tokenizer_path(B), with_groups=True
    ).collect()
    told = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got}
    assert len(got) == len(texts)
    assert [told[i] for i in range(len(texts))] == expected(texts, plain)
    for r in got:
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256


def test_wide_groups_are_linked_by_distinct_ids(monkeypatch):
    a = token_align.vocabulary(token_align.byte_level, queries.tokenizer_path(A))
    b = token_align.vocabulary(token_align.pieces, queries.tokenizer_path(B))
    raw = [t.encode() for t in [*ODD, prose(5, 60), "x" * 700]]
    usual = token_align.align_texts(a, b, raw)
    monkeypatch.setattr(token_align, "WIDE", 1)
    wide = token_align.align_texts(a, b, raw)
    assert np.array_equal(usual.pairs, wide.pairs) and np.array_equal(usual.texts, wide.texts)
    for x, y in zip(usual.numbers + usual.times, wide.numbers + wide.times, strict=True):
        assert np.array_equal(x, y)


def test_cuts_far_from_the_middle():
    # One shared end, far from the middle; and an interval without any.
    ends_a, ends_b = np.array([1, 3, 5, 7, 9, 11, 20, 30]), np.array([1, 2, 4, 6, 8, 10, 20, 25, 30])
    whole = token_align.Intervals(*[np.array([x]) for x in (0, 8, 0, 9)])
    found = token_align.groups(ends_a, ends_b, whole)
    assert found.a.tolist() == [0, 1, 7] and found.a_end.tolist() == [1, 7, 8]
    assert found.b.tolist() == [0, 1, 7] and found.b_end.tolist() == [1, 7, 9]


def test_empty_and_null_rows(empty, nulls, spark):
    paths = queries.tokenizer_path(A), queries.tokenizer_path(B)
    assert token_align.align(empty, *paths).count() == 0
    got = token_align.align(nulls.where("doc_id IS NULL"), *paths).collect()
    assert [(r.doc_id, r.n_a, r.count_sum, r.groups_sha256) for r in got] == [(None, 0, 0, "")] * 3


def test_registered_query(spark, tmp_path, docs, plain):
    short = docs.where("text IS NULL OR length(text) < 2000").select("doc_id", "text")
    short.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op11_align"](spark, str(tmp_path))
    held = [(r.doc_id, r.text) for r in short.collect()]
    told = expected([t for _, t in held], plain)
    mine = [(r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect()]
    assert sorted(mine) == sorted((d, *row) for (d, _), row in zip(held, told, strict=True))
