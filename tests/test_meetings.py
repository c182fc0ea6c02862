"""Meetings of entries against a loop over all pairs."""

import random

import pyarrow as pa
import pytest

from wiregrid.operators import meetings
from wiregrid.operators.meetings import met_in_part

MAPS, PARTS, T = ["map0", "map1"], 3, 0.4


def entries(rng, rows, sided):
    made = []
    for seq in range(rows):
        n = rng.randint(1, 12)
        own, want = rng.choice([(0, 0), (0, 0), (n, rng.randint(1, 3))])
        made.append(dict(
            key=rng.randint(0, 3), seq=seq, n=n, map0=rng.getrandbits(4), map1=-rng.getrandbits(4),
            wide=[rng.getrandbits(3) for _ in range(PARTS)] if n > 6 else None, depth=1,
            pos=rng.randint(1, n), own=own, want=want, side=rng.randint(0, 1) if sided else None,
            early=rng.random() < 0.6,
        ))
    return made


def bits(one, two):
    return sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(one, two))


def may_match(a, b):
    small, large = (a, b) if (a["n"], a["seq"]) <= (b["n"], b["seq"]) else (b, a)
    both = a["n"] + b["n"]
    most = both - 2 * T / (1 + T) * both + 1e-9
    reach = 1 + min(a["n"] - a["pos"], b["n"] - b["pos"])
    early = small["early"]
    if a["side"] is not None:
        if a["n"] == b["n"]:
            early = (a if a["side"] == 0 else b)["early"]
        if (a["side"], b["side"]) != (0, 1):
            return False
    return (
        a["key"] == b["key"] and early and T * large["n"] <= small["n"] + 1e-9
        and reach >= T / (1 + T) * both - 1e-9
        and a["own"] == b["want"] and a["want"] == b["own"]
        and bits([a[m] for m in MAPS], [b[m] for m in MAPS]) <= most
        and (a["wide"] is None or b["wide"] is None or bits(a["wide"], b["wide"]) <= most)
    )


@pytest.mark.parametrize("sided", [False, True])
@pytest.mark.parametrize("rows", [1, 2, 7, 120])
def test_pairs_are_those_of_the_loop(sided, rows):
    rng = random.Random(rows)
    schema = pa.schema(
        [(c, pa.int64()) for c in ("key", "seq", "n", *MAPS)] + [("wide", pa.list_(pa.int64()))]
        + [(c, pa.int32()) for c in ("depth", "pos", "own", "want", "side")] + [("early", pa.bool_())]
    )
    for _ in range(20):
        made = entries(rng, rows, sided)
        found = met_in_part(pa.Table.from_pylist(made, schema), T, 1e-9, MAPS, PARTS)
        got = sorted(zip(found["lo"].to_pylist(), found["hi"].to_pylist()))
        expected = sorted(
            (a["seq"], b["seq"]) for i, a in enumerate(made) for b in made[i + 1:] if may_match(a, b)
        )
        assert got == expected


TEN = [f"map{i}" for i in range(10)]


def crowded(rng, rows, sized, sided):
    """Entries of one key whose bits are those of random sets, some of them near copies."""
    made, sets = [], []
    for seq in range(rows):
        words = set(rng.sample(range(1 << 20), sized()))
        if sets and rng.random() < 0.2:
            words = set(list(rng.choice(sets)) + rng.sample(range(1 << 20), rng.randint(0, 40)))
        sets.append(words)
        whole = 0
        for word in words:
            whole ^= 1 << (word * 2654435761 % 640)
        parts = [(whole >> 64 * i) & (2**64 - 1) for i in range(10)]
        n = len(words)
        made.append(dict(
            key=5, seq=seq, n=n, wide=None, depth=1, pos=rng.randint(1, max(1, n // 3)), own=0, want=0,
            side=rng.randint(0, 1) if sided else None, early=rng.random() < 0.8,
            **{name: part - (part >> 63 << 64) for name, part in zip(TEN, parts)},
        ))
    return made


def table_of(made, maps):
    schema = pa.schema(
        [(c, pa.int64()) for c in ("key", "seq", "n", *maps)] + [("wide", pa.list_(pa.int64()))]
        + [(c, pa.int32()) for c in ("depth", "pos", "own", "want", "side")] + [("early", pa.bool_())]
    )
    return pa.Table.from_pylist(made, schema)


@pytest.mark.parametrize("sided", [False, True])
@pytest.mark.parametrize("most", [8, 60, 150, 500])
def test_pairs_of_a_crowded_key_are_those_of_the_loop(sided, most, monkeypatch):
    monkeypatch.setattr(meetings, "_COLUMNS", 50)
    monkeypatch.setattr(meetings, "_CHUNK", 700)
    rng = random.Random(most)
    made = crowded(rng, 260, lambda: rng.randint(1, most), sided)
    monkeypatch.setitem(globals(), "MAPS", TEN)
    found = met_in_part(table_of(made, TEN), T, 1e-9, TEN, PARTS)
    got = sorted(zip(found["lo"].to_pylist(), found["hi"].to_pylist()))
    expected = sorted(
        (a["seq"], b["seq"]) for i, a in enumerate(made) for b in made[i + 1:] if may_match(a, b)
    )
    assert got == expected and got


@pytest.mark.parametrize("sided", [False, True])
def test_few_pairs_of_a_crowded_key_are_looked_at_singly(sided, monkeypatch):
    looked = []
    pairs = meetings._Entries.pairs
    monkeypatch.setattr(
        meetings._Entries, "pairs",
        lambda self, left, right, *rest: looked.append(len(left)) or pairs(self, left, right, *rest),
    )
    rng = random.Random(3)
    made = crowded(rng, 2_000, lambda: rng.randint(20, 40), sided)
    found = met_in_part(table_of(made, TEN), T, 1e-9, TEN, PARTS)
    # Sizes and places leave several hundred thousand.
    assert found.num_rows <= sum(looked) < 20_000
