"""Clustering against a plain first-match loop, one random feed per block."""

import hashlib
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wiregrid.operators import graph, leaders
from wiregrid.operators.clusters import (
    cluster_articles,
    leader_of_articles,
    member_chunks,
    members_from_json,
)
from wiregrid.operators.simjoin import Tuning, build_index, pairs_inside, signatures, similar_pairs

SCHEMA = "case int, id string, ticker string, headline string, seq long"

PLAIN = Tuning()
STRESSED = Tuning(
    crowded=4, max_depth=3, rows_per_salt=2, pairs_min=2_500, pairs_per_set=0,
    signature_rows_max=24, heavy_rows_min=3, local_edges=8,
)


def similarity(left, right):
    a, b = set(re.findall(r"\w+", left.lower())), set(re.findall(r"\w+", right.lower()))
    return len(a & b) / len(a | b) if a | b else 0.0


def first_match(headlines, threshold):
    """Index of the leader of each headline."""
    leaders, result = [], []
    for i, text in enumerate(headlines):
        for lead in leaders:
            if similarity(headlines[lead], text) >= threshold:
                result.append(lead)
                break
        else:
            leaders.append(i)
            result.append(i)
    return result


def random_feeds(cases, seed):
    rng = random.Random(seed)
    rows, feeds = [], {}
    for case in range(cases):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 6, 12, 30]))]
        weights = [1 / (i + 1) for i in range(len(vocabulary))]
        headlines = []
        for _ in range(rng.randint(1, 40)):
            if headlines and rng.random() < 0.25:
                headlines.append(rng.choice(headlines))
            else:
                size = rng.choice([0, 1, 2, 3, 5, 8, 12])
                headlines.append(" ".join(rng.choices(vocabulary, weights, k=size)))
        feeds[case] = headlines
        for i, text in enumerate(headlines):
            rows.append((case, f"c{case}a{i}", f"T{i % 3}", text, case * 1000 + i))
    return rows, feeds


@pytest.mark.parametrize("threshold, tuning", [(0.4, PLAIN), (0.4, STRESSED), (0.7, STRESSED)])
def test_every_article_gets_the_leader_the_loop_finds(spark, threshold, tuning):
    rows, feeds = random_feeds(60, seed=int(threshold * 10))
    articles = spark.createDataFrame(rows, SCHEMA)
    found = {
        r["seq"]: r["leader_seq"]
        for r in leader_of_articles(
            articles, threshold, block_by=["case"], tuning=tuning
        ).collect()
    }
    assert len(found) == len(rows)
    for case, headlines in feeds.items():
        expected = first_match(headlines, threshold)
        got = [found[case * 1000 + i] - case * 1000 for i in range(len(headlines))]
        assert got == expected, (case, headlines)


@pytest.mark.parametrize("threshold", [0.1, 1.0])
def test_unusual_thresholds_without_blocks(spark, threshold):
    rng = random.Random(7)
    pool = [f"t{i}" for i in range(40)]
    headlines = [" ".join(rng.sample(pool, rng.randint(1, 9))) for _ in range(250)]
    headlines += headlines[:30]
    rows = [(0, f"a{i}", "T", h, i) for i, h in enumerate(headlines)]
    found = leader_of_articles(
        spark.createDataFrame(rows, SCHEMA), threshold, tuning=PLAIN
    ).collect()
    got = [r["leader_seq"] for r in sorted(found, key=lambda r: r["seq"])]
    assert got == first_match(headlines, threshold)


def test_a_third_near_copies_and_a_third_copies(spark):
    """The hot groups are cut into batches and still end up whole."""
    rng = random.Random(3)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(1500):
        kind = i * 3 // 1500
        if kind == 0:
            text = " ".join(rng.sample(words, 8))
        elif kind == 1:
            text = f"breaking news about the big merger of two firms id{i}"
        else:
            text = "same headline again and again"
        rows.append((0, f"a{i}", "T", text, i))
    tuning = Tuning(
        crowded=100, pairs_min=20_000, pairs_per_set=0, signature_rows_max=150,
        rows_per_salt=50, heavy_rows_min=100,
    )
    clusters, members = cluster_articles(spark.createDataFrame(rows, SCHEMA), 0.4, tuning=tuning)
    sizes = sorted(r["article_count"] for r in clusters.collect())
    assert sum(sizes) == 1500
    assert sizes[-2:] == [500, 500]
    assert members.count() == 1500
    assert members.select("article_id").distinct().count() == 1500
    expected = first_match([r[3] for r in rows], 0.4)
    assert clusters.count() == len(set(expected))


def feed(spark, *headlines):
    return spark.createDataFrame(
        [(0, f"id{i}", f"T{i}", h, i) for i, h in enumerate(headlines)], SCHEMA
    )


def test_clusters_name_their_first_article(spark):
    clusters, members = cluster_articles(
        feed(
            spark,
            "Apple Q3 earnings beat analyst estimates",
            "Tesla recalls vehicles over brake failure",
            "Apple Q3 earnings beat Wall Street estimates",
        ),
        0.3,
    )
    found = {r["cluster_seq"]: r for r in clusters.collect()}
    assert sorted(found) == [0, 1]
    assert found[0]["article_count"] == 2 and found[1]["article_count"] == 1
    assert found[0]["ticker"] == "T0"
    assert found[0]["representative_headline"] == "Apple Q3 earnings beat analyst estimates"
    assert found[0]["cluster_id"] == hashlib.sha256(b"id0|2|T0").hexdigest()[:16]
    chunks = {r["cluster_id"]: r["article_ids"] for r in member_chunks(members).collect()}
    assert chunks[found[0]["cluster_id"]] == ["id0", "id2"]
    pieces = member_chunks(members, chunk=1).where(F.col("cluster_id") == found[0]["cluster_id"])
    assert [r["article_ids"] for r in pieces.orderBy("chunk").collect()] == [["id0"], ["id2"]]


def test_threshold_at_or_below_zero_joins_everything(spark):
    clusters, members = cluster_articles(feed(spark, "Apple earnings", "", "zebra"), 0.0)
    assert [r["article_count"] for r in clusters.collect()] == [3]
    assert [r["article_id"] for r in members.orderBy("member_pos").collect()] == ["id0", "id1", "id2"]


def test_threshold_above_one_keeps_everything_apart(spark):
    clusters, _ = cluster_articles(feed(spark, "Apple", "Apple"), 1.5)
    assert clusters.count() == 2


def test_empty_feed_and_wordless_headlines(spark):
    assert cluster_articles(spark.createDataFrame([], SCHEMA), 0.4).clusters.count() == 0
    clusters, _ = cluster_articles(feed(spark, "", "...", "", "word"), 0.4)
    assert clusters.count() == 4


def test_members_from_json(spark):
    stored = spark.createDataFrame(
        [("c1", '["a", "b"]'), ("c2", "[]"), ("c3", None)], "cluster_id string, article_ids string"
    )
    rows = members_from_json(stored).orderBy("cluster_id", "member_pos").collect()
    assert [(r["cluster_id"], r["member_pos"], r["article_id"]) for r in rows] == [
        ("c1", 0, "a"), ("c1", 1, "b"),
    ]


def test_shared_hashes_are_told_apart_by_tokens(spark):
    """Pairs found on hashes that may collide are verified on the tokens."""
    rows, feeds = random_feeds(20, seed=9)
    index = build_index(
        spark.createDataFrame(rows, SCHEMA), 0.4, F.col("case").cast("string"), STRESSED
    )
    assert index.faithful
    entries = signatures(index, index.ordered)
    exact = set(map(tuple, similar_pairs(index, entries, entries).collect()))
    index.faithful = False
    assert set(map(tuple, similar_pairs(index, entries, entries, salted=True).collect())) == exact
    expected = set()
    for case, headlines in feeds.items():
        first = {}
        for i, h in enumerate(headlines):
            first.setdefault(frozenset(re.findall(r"\w+", h.lower())), i)
        kept = sorted(i for words, i in first.items() if words)
        expected |= {
            (case * 1000 + i, case * 1000 + j)
            for i in kept for j in kept if i < j and similarity(headlines[i], headlines[j]) >= 0.4
        }
    assert exact == expected


def test_pairs_inside_are_all_similar_pairs(spark):
    """Leaving out late entries of the smaller sets loses no pair, at any depth of signatures."""
    rows, _ = random_feeds(20, seed=14)
    for threshold in (0.3, 0.4, 0.7, 1.0):
        index = build_index(
            spark.createDataFrame(rows, SCHEMA), threshold, F.col("case").cast("string"), STRESSED
        )
        entries = signatures(index, index.ordered)
        pairs, compared = pairs_inside(index, entries)
        found = sorted(map(tuple, pairs.collect()))
        assert compared >= len(found)
        assert found == sorted(map(tuple, similar_pairs(index, entries, entries).collect())), threshold


def test_chance_meetings_make_few_batches(spark, monkeypatch):
    """Pairs that share common words only do not cut the feed: batches follow what is left of them."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(120)]
    rows = [(0, f"a{i}", "T", " ".join(rng.sample(words, 12)), i) for i in range(900)]
    batches = []
    end = leaders._batch_end
    monkeypatch.setattr(leaders, "_batch_end", lambda *args: batches.append(1) or end(*args))
    tuning = Tuning(crowded=10_000, pairs_min=1_500, pairs_per_set=0, signature_rows_max=10_000)
    found = leader_of_articles(spark.createDataFrame(rows, SCHEMA), 0.4, tuning=tuning).collect()
    got = {r["seq"]: r["leader_seq"] for r in found}
    assert [got[i] for i in range(900)] == first_match([r[3] for r in rows], 0.4)
    assert len(batches) <= 4


def test_null_blocks_stay_apart(spark):
    rows = [("1", "t", "big oil deal", 1, "x", None), ("2", "t", "big oil deal", 2, None, "x")]
    feed = spark.createDataFrame(
        rows, "id string, ticker string, headline string, seq long, a string, b string"
    )
    clusters, _ = cluster_articles(feed, block_by=["a", "b"])
    assert clusters.count() == 2


def test_hashes_of_few_bits_change_nothing(spark):
    """Tokens and signatures that share hashes bring more pairs together; the tokens decide."""
    rows, feeds = random_feeds(25, seed=21)
    articles = spark.createDataFrame(rows, SCHEMA)
    for bits in (3, 6):
        tuning = replace(STRESSED, hash_bits=bits)
        found = leader_of_articles(articles, 0.4, block_by=["case"], tuning=tuning)
        got = {r["seq"]: r["leader_seq"] for r in found.collect()}
        for case, headlines in feeds.items():
            mine = [got[case * 1000 + i] - case * 1000 for i in range(len(headlines))]
            assert mine == first_match(headlines, 0.4), (bits, case)


def test_long_headlines_shuffle_little(spark, tmp_path):
    """The join of signatures carries entries of a fixed size, not the sets."""
    rng = random.Random(2)
    pool = [f"word{i}" for i in range(20_000)]
    texts = [" ".join(rng.sample(pool, 1500)) for _ in range(100)]
    rows = [(0, f"a{i}", "T", t, i) for i, t in enumerate(texts)]
    index = build_index(spark.createDataFrame(rows, SCHEMA), 0.4)
    entries = signatures(index, index.ordered)
    width = sum({"long": 8, "bigint": 8, "int": 8}[f.dataType.simpleString()] for f in entries.schema)
    assert entries.count() * width < 20 * sum(map(len, texts)) / 2
    assert similar_pairs(index, entries, entries).count() == 0


def test_a_long_chain_takes_few_jobs(spark):
    """Each headline is like the next one only."""
    words = [f"w{i}" for i in range(310)]
    headlines = [" ".join(words[i : i + 10]) for i in range(300)]
    rows = [(0, f"a{i}", "T", h, i) for i, h in enumerate(headlines)]
    tracker = spark.sparkContext.statusTracker()
    for tuning in (PLAIN, replace(PLAIN, local_edges=100)):
        name = f"chain-{tuning.local_edges}"
        spark.sparkContext.setJobGroup(name, name)
        found = leader_of_articles(spark.createDataFrame(rows, SCHEMA), 0.8, tuning=tuning).collect()
        jobs = len(tracker.getJobIdsForGroup(name))
        got = [r["leader_seq"] for r in sorted(found, key=lambda r: r["seq"])]
        assert got == first_match(headlines, 0.8)
        assert tuning is not PLAIN or jobs < 100
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("local_edges", [1, 7, 60, 10_000])
def test_leaders_of_random_graphs(spark, local_edges):
    rng = random.Random(local_edges)
    edges = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(110)} | {(0, i) for i in range(200, 230)})
    pairs = spark.createDataFrame(edges, "lo long, hi long")
    got = {r["hi"]: r["leader"] for r in graph.leaders(pairs, len(edges), local_edges).collect()}
    followers, expected = set(), {}
    for hi in sorted({b for _, b in edges}):
        first = [a for a, b in edges if b == hi and a not in followers]
        if first:
            followers.add(hi)
            expected[hi] = min(first)
    assert got == expected


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    edges = [tuple(sorted(rng.sample(range(150), 2))) for _ in range(90)] + [(i, i + 1) for i in range(300, 400)]
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = graph.components(spark.createDataFrame(edges, "lo long, hi long")).collect()
    assert {r["node"]: r["root"] for r in found} == root
