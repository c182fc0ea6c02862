"""Token files, packing, sharding, pieces of a vocabulary and chat formatting."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute import sha
from tests.llm.test_dedup import ordered, pairs
from wiregrid.llm import bestfit_pack, chat_format, sentence_pieces, shard_kk, token_files, tokens

P = pytest.importorskip("public_tokenizers")
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PIECES = P.path("piece_bpe_32k.model")


def whole(path):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    return lambda text: known.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(
    ("path", "split"), [(BYTES, tokens.keeps_white), (WORDS, tokens.drops_white)]
)
def test_ids_equal_the_library(path, split, rows):
    draw = random.Random(3)
    texts = [t or "" for _, t, _, _ in rows]
    texts += [
        "".join(draw.choice(" \n\t\r\xa0　\x1cab'sÉ1.!́<|>ΑΣ") for _ in range(draw.randint(0, 30)))
        for _ in range(2000)
    ]
    texts += [
        "".join(
            draw.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", " ", "\n", "a1", "'s"])
            for _ in range(draw.randint(1, 8))
        )
        for _ in range(1000)
    ]
    known, worker = whole(path), tokens.encoder(path, split)
    ids, sizes = worker.encode(texts)
    at = np.concatenate(([0], np.cumsum(sizes)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == list(map(known, texts))


def test_kept_stretches_are_bounded():
    worker = tokens.Encoder(WORDS, tokens.drops_white, most=50)
    for text in ("one two three", "x" * 100, "four five"):
        worker.encode([text])
    assert worker.held < 120


def test_token_files_round_trip(docs):
    known = whole(BYTES)
    index = token_files.write_tokens(docs, BYTES)
    found = token_files.read_tokens(index, ids=True).collect()
    expected, at = [], 0
    for doc_id, text in sorted(pairs(docs), key=lambda x: (x[0], x[1] or "")):
        ids = [*known(text or ""), 0]
        expected.append((doc_id, at, len(ids), crc(ids), ids))
        at += len(ids)
    assert ordered(found) == ordered(expected)


def test_token_files_of_several_parts(docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TEXT", 2000)
    index = token_files.write_tokens(docs, BYTES)
    found = sorted(token_files.read_tokens(index).collect(), key=lambda r: r.start)
    assert index.count() > 3 and [r.doc_id for r in found] == sorted(d for d, _ in pairs(docs))
    assert [r.start for r in found][1:] == np.cumsum([r.n_tokens for r in found]).tolist()[:-1]


def test_token_files_of_nothing(empty, nulls, docs):
    assert token_files.read_tokens(token_files.write_tokens(empty, BYTES)).count() == 0
    assert token_files.read_tokens(token_files.write_tokens(nulls, BYTES)).count() == docs.count()


def check_packing(found, capacity):
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(nulls):
    known = whole(WORDS)
    found = bestfit_pack.pack(bestfit_pack.cut_pieces(nulls, WORDS, 256), 256).collect()
    expected = []
    for doc_id, text in pairs(nulls):
        ids = [*known(text or ""), 0]
        for k in range(-(-len(ids) // 256)):
            part = ids[256 * k : 256 * k + 256]
            expected.append((doc_id, k, 256 * k, len(part), crc(part)))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert ordered(got) == ordered(expected)
    short = [r.length for r in found if r.length < 256]
    full = len(found) - len(short)
    assert check_packing(found, 256) <= full + len(bestfit_pack.best_fit(short, 256))


def test_packing_in_levels(spark):
    draw = random.Random(1)
    rows = [(i, draw.randint(1, 100), 5) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "name long, length long, offset long")
    found = bestfit_pack.pack(pieces, 100, group=40).collect()
    assert sorted((r.name, r.length) for r in found) == [(i, n) for i, n, _ in rows]
    assert check_packing(found, 100) <= sum(n for _, n, _ in rows) / 100 * 1.02
    assert bestfit_pack.pack(pieces.where("name < 0"), 100).count() == 0


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(i, 10 * i % 90 + 1, 3, "g", True, 7, "x") for i in range(50)]
    schema = "`row` long, length long, uid int, `group` string, again boolean, _uid int, sequence_id string"
    found = bestfit_pack.pack(spark.createDataFrame(rows, schema), 100, group=20).collect()
    got = [(r["row"], r["length"], r["uid"], r["group"], r["again"], r["_uid"]) for r in found]
    assert sorted(got) == [r[:6] for r in rows] and check_packing(found, 100)


def test_swaps_empty_a_bin():
    """Best fit needs four bins here; a swap makes room so that three suffice."""
    lengths = [6, 6, 4, 4, 5, 5]
    bins = [[0, 4 - 2], [1], [3, 4], [5]]
    packed = bestfit_pack.Search(lengths, bins, 10).run(10)
    assert len(packed) == 3 and sorted(i for b in packed for i in b) == list(range(6))


def test_search_goes_on_to_the_bound():
    """Lengths of which best fit wastes a lot: the swaps save most of it."""
    draw = random.Random(0)
    lengths = [draw.randint(400, 1300) for _ in range(3000)]
    least, plain = bestfit_pack.least_bins(lengths, 2048), len(bestfit_pack.best_fit(lengths, 2048))
    found = len(bestfit_pack.pack_lengths(lengths, 2048))
    assert plain >= least + 20 and least <= found <= least + 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_bound_is_none_too_high(lengths):
    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        found = fewest(rest[1:], [*rooms, 12 - rest[0]])
        for k, room in enumerate(rooms):
            if room >= rest[0]:
                found = min(found, fewest(rest[1:], [*rooms[:k], room - rest[0], *rooms[k + 1 :]]))
        return found

    least = fewest(sorted(lengths)[::-1], [])
    assert bestfit_pack.least_bins(lengths, 12) <= least
    assert least <= len(bestfit_pack.pack_lengths(lengths, 12))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins_hold_every_piece(lengths):
    bins = bestfit_pack.pack_lengths(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= max(len(bestfit_pack.best_fit(lengths, 50)), 0)


def test_shards(nulls, empty):
    found = shard_kk.shard_documents(nulls, 7).collect()
    texts = {d: t for d, t in pairs(nulls)}
    shards, groups = defaultdict(list), {}
    for r in found:
        text = (texts[r.doc_id] or "").encode()
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
        assert r.law == "bytes" and r.grown_shard is None
        shards[r.shard].append(r)
        assert groups.setdefault(text, r.shard) == r.shard
    assert len(found) == nulls.count() and set(shards) <= set(range(7))
    for held in shards.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    assert shard_kk.shard_documents(empty).count() == 0


def test_shards_do_not_follow_the_partitions(nulls):
    """Many texts of one length, so that weights tie."""
    docs = nulls.select("doc_id", "text").unionByName(
        nulls.sparkSession.range(300).selectExpr("id + 5000 AS doc_id", "sha2(string(id), 256) AS text")
    )
    columns = "doc_id", "size", "text_crc32", "shard", "slot"
    once, again = (
        shard_kk.shard_documents(docs.repartition(n, c), 7).select(*columns).collect()
        for n, c in ((3, "text"), (6, "doc_id"))
    )
    assert ordered(once) == ordered(again)


def test_shards_in_levels(spark):
    draw = random.Random(2)
    rows = [(str(i), draw.randint(16, 4000)) for i in range(3000)]
    groups = spark.createDataFrame(rows, "digest string, weight long")
    found = shard_kk.group_shards(groups, 8, bucket=20).collect()
    sums, weight = defaultdict(int), dict(rows)
    for r in found:
        sums[r.shard] += weight[r.digest]
    assert len(found) == 3000 and max(sums.values()) - min(sums.values()) < 40


def test_places_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(shard_kk, "BLOCK", 10)
    rows = spark.range(500).selectExpr("id AS uid", "CAST(id % 3 AS int) AS shard")
    held = defaultdict(list)
    for r in shard_kk.places(rows, 500, 3).collect():
        held[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in held.values()) and len(held) == 3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 90), min_size=1, max_size=40), st.integers(1, 6))
def test_differencing_places_everything(weights, shards):
    slots = [x[0] for x in shard_kk.difference([[w] for w in weights], shards)]
    sums = [0] * shards
    for w, s in zip(weights, slots, strict=True):
        sums[s] += w
    assert max(sums) - min(sums) <= max(weights)


def test_pieces_equal_the_library(docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = sentence_pieces.decode(sentence_pieces.encode(docs, PIECES), PIECES).collect()
    expected = []
    for doc_id, text in pairs(docs):
        ids = model.encode(text or "")
        said = model.decode(ids)
        expected.append((doc_id, len(ids), crc(ids), sha(said), len(said)))
    assert ordered(found) == ordered(expected)
    assert sentence_pieces.decode(sentence_pieces.encode(empty, PIECES), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("▁ \nabcdeinorst.,é日1<>=", max_size=40))
def test_pieces_of_any_text(text):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    worker = sentence_pieces.encoder(PIECES)
    ids, _ = worker.encode([text])
    assert ids.tolist() == model.encode(text)
    assert worker.decode(ids) == model.decode(model.encode(text))


TURNS = [
    (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "user", "</s>[INST] ok [/INST]"),
    (1, 3, None, None), (2, 1, "system", ""), (2, 1, "system", ""), (2, None, "assistant", "a\nb"),
    (3, 1, "assistant", ""), (3, 2, "assistant", "[⁠INST] <⁠⁠/s> <s>"), (None, 1, "[ROLE]", "x"),
]


def test_conversations_read_back(spark):
    rows = spark.createDataFrame(
        [(*t, 1) for t in TURNS], "conv_id long, turn int, role string, text string, piece int"
    )
    found = chat_format.read_back(chat_format.format_conversations(rows)).collect()
    held = defaultdict(list)
    for conv_id, turn, role, text in TURNS:
        held[conv_id].append((turn or -1, role or "", text or ""))
    expected = []
    for conv_id, turns in held.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        expected.append((conv_id, len(turns), sha(told), len(loss), sha(loss)))
    assert ordered(tuple(r)[:5] for r in found) == ordered(expected)
    none = rows.where("turn > 9")
    assert chat_format.read_back(chat_format.format_conversations(none)).count() == 0


@given(st.text("<>/sINT[]⁠ a", max_size=30))
def test_escape_can_be_undone(text):
    controls = chat_format.Controls(chat_format.CONTROLS)
    safe = controls.escape(text)
    assert controls.unescape(safe) == text
    assert not any(c in safe for c in chat_format.CONTROLS)


def rendered(source, **given):
    return "".join(text for text, _ in chat_format.Template(source, ["<s>"]).render(**given))


def test_template_language():
    people = [{"n": "Ann"}, {"n": "<s>"}]
    source = (
        "{% set a = 'x' ~ 1 + 2 -%}  {{ a }}{% for p in people %}{{ loop.index }}:{{ p.n | escape }}"
        "{% if not loop.last and p['n'] != 'q' %}, {% elif false %}?{% else %}.{% endif %}{% endfor %}"
        "{{ nothing.at.all }}{{ (1 < 2) and 'yes' or 'no' }}"
    )
    assert rendered(source.replace("1 + 2", "'3'"), people=iter(people)) == "x31:Ann, 2:<⁠s>.yes"


def test_template_is_folded():
    made = chat_format.Template("a{{ 'b' ~ 1 | upper }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}")
    assert made.tree == [("text", "ab1c")]


def test_generation_is_marked():
    made = chat_format.Template("u{% generation %}{{ x }}!{% endgeneration %}v")
    assert list(made.render(x="a")) == [("u", False), ("a", True), ("!", True), ("v", False)]


@pytest.mark.parametrize(
    "source",
    ["{{ x() }}", "{% for %}{% endfor %}", "{% if a %}", "{{ a | open }}", "{{ 1 + }}", "{% x %}",
     "{{ a[b] }}", "{{ 'a }}"],
)
def test_other_templates_are_refused(source):
    with pytest.raises(chat_format.TemplateError):
        chat_format.Template(source)
