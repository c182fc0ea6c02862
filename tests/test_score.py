import random

import pytest
from pyspark.sql import functions as F

from wiregrid.functions.lexicon import DEFAULT_LEXICON, lexicon_from_rows
from wiregrid.operators import lexicon_match
from wiregrid.operators.lexicon_match import LEXICON, lexicon_table
from wiregrid.operators.score import lexicon_hits, python_scorer, run_scorer, score_articles

CASES = [
    ("Apple reports record quarterly earnings, beats EPS estimates", "earnings", True),
    ("Microsoft announces acquisition of gaming company for $10B", "merger", True),
    ("FTC launches antitrust investigation into Google", "regulation", True),
    ("Tesla CEO Elon Musk to step down as board chair", "executive", True),
    ("Weather forecast for the weekend", None, False),
    ("", "other", False),
]


def articles(spark, *pairs):
    rows = [(f"a{i}", h, s) for i, (h, s) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id string, headline string, summary string")


def test_known_headlines(spark):
    df = articles(spark, *[(h, "Sunny skies expected across the region." if "Weather" in h else "") for h, _, _ in CASES])
    found = score_articles(df).orderBy("article_id").collect()
    for (headline, kind, relevant), row in zip(CASES, found):
        assert row["is_relevant"] == relevant, headline
        assert kind is None or row["event_type"] == kind
    assert found[5]["relevance_score"] == 0.0
    assert found[5]["reason"] == "No significant stock-relevant keywords detected."


def expected_score(text):
    hits = [
        (sum(k in text for k in e.high), sum(k in text for k in e.medium), e.event_type)
        for e in DEFAULT_LEXICON
    ]
    high, medium, kind = 0, 0, "other"
    for h, m, t in hits:
        if (h, m) > (high, medium):
            high, medium, kind = h, m, t
    relevance = min((2 * sum(h for h, _, _ in hits) + sum(m for _, m, _ in hits)) / 10, 1.0)
    importance = min(20 * high + 5 * medium, 100)
    level = "high" if high >= 2 else "medium" if high == 1 or medium >= 2 else "low"
    return relevance, importance, kind, level, relevance >= 0.4 and importance >= 30


def test_random_texts_score_as_counted(spark):
    rng = random.Random(5)
    words = [k for e in DEFAULT_LEXICON for k in e.high + e.medium] + ["x", "the", "zzz"]
    pairs = [
        (" ".join(rng.choices(words, k=rng.randint(0, 6))).title(), " ".join(rng.choices(words, k=rng.randint(0, 3))))
        for _ in range(400)
    ]
    rows = score_articles(articles(spark, *pairs)).collect()
    for row in rows:
        headline, summary = pairs[int(row["article_id"][1:])]
        got = (row["relevance_score"], row["importance_score"], row["event_type"],
               row["confidence"], row["include_in_digest"])
        assert got == expected_score(f"{headline} {summary}".lower())


def test_thresholds_and_lexicon_are_arguments(spark):
    lexicon = lexicon_from_rows([("legal", "high", "foo"), ("macro", "medium", "bar")])
    df = articles(spark, ("foo", "bar"))
    row = score_articles(df, lexicon, relevance_threshold=0.3, importance_threshold=20).first()
    assert (row["event_type"], row["is_relevant"], row["include_in_digest"]) == ("legal", True, True)


def hits_of(df, lexicon):
    found = lexicon_hits(df, lexicon).select("id", "total_high", "total_medium", "best").collect()
    return sorted(
        (str(r.id), r.total_high, r.total_medium, r.best.high, r.best.medium,
         r.best.event_type if r.best.high + r.best.medium else None)
        for r in found
    )


def test_a_lexicon_table_counts_like_one_in_the_plan(spark):
    rng = random.Random(11)
    letters = ["a", "b", "é", "\U0001f642", " ", "\n", ".", "(", "z"]
    made = {"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(300)}
    rows = [
        (("earnings", "legal", "macro")[i % 3], ("high", "medium")[i % 2], word)
        for i, word in enumerate(sorted(made))
    ]
    # The empty keyword, one listed twice, one of two types, one that never occurs.
    rows += [("legal", "high", ""), ("macro", "medium", "ab"), ("macro", "medium", "ab"),
             ("earnings", "high", "ab"), ("earnings", "high", "not there at all")]
    lexicon = lexicon_from_rows(rows)
    pairs = [("".join(rng.choices(letters, k=rng.randint(0, 60))), None) for _ in range(200)]
    pairs += [("", ""), (None, None), ("x" * 50_000, "ab"), ("AB", "Éa")]
    df = articles(spark, *pairs).unionByName(articles(spark, ("ab", "ba"), ("(", ")")))
    df = df.unionByName(df.limit(3).withColumn("id", F.lit(None).cast("string"))).repartition(4)
    assert hits_of(df, lexicon_table(df, lexicon)) == hits_of(df, lexicon)
    usual = score_articles(df, DEFAULT_LEXICON).orderBy("article_id", "reason").collect()
    table = score_articles(df, lexicon_table(df, DEFAULT_LEXICON)).orderBy("article_id", "reason")
    assert table.collect() == usual


def test_large_and_empty_lexicons(spark):
    df = articles(spark, ("keyword5999 and keyword17", ""), ("nothing", ""))
    large = lexicon_from_rows([("legal", "high", f"keyword{i}") for i in range(6_000)])
    # keyword1, 17, 5, 59, 599 and 5999 are substrings.
    assert [r[1] for r in hits_of(df, large)] == [6, 0]
    empty = spark.createDataFrame([], LEXICON)
    assert [r[1] for r in hits_of(df, empty)] == [0, 0]
    assert hits_of(df.limit(0), lexicon_table(df, large)) == []
    assert {r.event_type for r in score_articles(df, empty).collect()} == {"other"}
    nulls = spark.createDataFrame([("legal", "high", None, 0), ("macro", "medium", "and", 1)], LEXICON)
    assert [r[1:3] for r in hits_of(df, nulls)] == [(0, 1), (0, 0)]
    with pytest.raises(ValueError):
        hits_of(df, spark.createDataFrame([("legal", "huge", "x", 0)], LEXICON))


def test_no_keyword_is_part_of_the_plan(spark):
    df = articles(spark, ("one secretword", ""))
    plan = score_articles(df, spark.createDataFrame([("legal", "high", "secretword", 0)], LEXICON))
    assert "secretword" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_python_scorer_isolates_failures(spark):
    def score_one(article):
        if article["headline"] == "boom":
            raise RuntimeError("no")
        return {
            "is_relevant": True, "relevance_score": 2.0 if article["headline"] == "wild" else 0.5,
            "importance_score": 10, "event_type": "other", "confidence": "low",
            "include_in_digest": False, "reason": "r",
        }

    found = run_scorer(articles(spark, ("ok", ""), ("boom", ""), ("wild", "")), python_scorer(score_one))
    assert [r["article_id"] for r in found.scores.collect()] == ["a0"]
    rejects = {r["article_id"]: r["reason"] for r in found.rejects.collect()}
    assert rejects == {"a1": "RuntimeError: no", "a2": "relevance"}


def test_a_scorer_must_return_the_contract(spark):
    with pytest.raises(ValueError):
        run_scorer(articles(spark, ("x", "")), lambda df: df.select(F.col("id").alias("article_id")))


def test_python_scorer_sets_wrong_kinds_aside(spark):
    good = {"is_relevant": True, "relevance_score": 0.5, "importance_score": 40,
            "event_type": "macro", "confidence": "low", "include_in_digest": False, "reason": "r"}
    wrong = {"1": {"importance_score": "high"}, "2": {"importance_score": 2**40}, "3": {"reason": 5}}
    articles = spark.createDataFrame(
        [(str(i), "h", "s") for i in range(5)], "id string, headline string, summary string"
    )
    scorer = python_scorer(lambda a: good | wrong.get(a["id"], {}))
    made = run_scorer(articles, scorer)
    assert sorted(r["article_id"] for r in made.scores.collect()) == ["0", "4"]
    assert sorted(r["article_id"] for r in made.rejects.collect()) == ["1", "2", "3"]


def test_grams_no_keyword_has_are_not_shuffled(spark, monkeypatch):
    """Where the index is too large for a broadcast by size, hashes of its grams still sort the texts' out."""
    rng = random.Random(5)
    letters = "abcdefgh"
    texts = [(f"t{i}", "".join(rng.choices(letters, k=400))) for i in range(40)]
    words = [text[9 * i : 9 * i + 8 + i % 5] for i, (_, text) in enumerate(texts)] + ["zzzzzzzzz"]
    articles = spark.createDataFrame(texts, "id string, text string")
    lexicon = spark.createDataFrame([("e", "high", word, 0) for word in words], LEXICON)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lexicon_match.candidates(articles, lexicon)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        got = {r["id"]: {word["keyword"] for word in r["words"]} for r in found.collect()}
        monkeypatch.setattr(lexicon_match, "BROADCAST_GRAMS", 0)
        shuffled = lexicon_match.candidates(articles, lexicon).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert got == {r["id"]: {word["keyword"] for word in r["words"]} for r in shuffled}
    for i, (name, text) in enumerate(texts):
        assert {word for word in words if word in text} <= got.get(name, set())


def test_many_grams_of_keywords_are_told_by_bits(spark, monkeypatch):
    """However many they are, grams that no keyword has are dropped before the shuffle."""
    rng = random.Random(6)
    texts = [(i, "".join(rng.choices("abcdefghij", k=300))) for i in range(30)]
    texts += [(30, None), (None, "abcdefghij" * 3)]
    words = [text[7 * i : 7 * i + 8 + i % 5] for i, text in texts[:30]] + ["efghijabcd", "zzzzzzzzz"]
    held = spark.createDataFrame(texts, "id long, text string")
    lexicon = spark.createDataFrame([("e", "high", word, 0) for word in words], LEXICON)
    monkeypatch.setattr(lexicon_match, "BROADCAST_GRAMS", 0)
    shown = []
    real = lexicon_match._among

    def among(met, grams, rows):
        left = real(met, grams, rows)
        shown.append((met.count(), left.count(), grams.join(met, "gram", "left_semi").join(left, "gram", "left_anti").count()))
        return left

    monkeypatch.setattr(lexicon_match, "_among", among)
    found = {r["id"]: {word["keyword"] for word in r["words"]} for r in lexicon_match.candidates(held, lexicon).collect()}
    for i, text in texts:
        assert {word for word in words if word in (text or "")} <= found.get(i, set())
    # No gram of a keyword is lost, most others are.
    assert len(shown) == 2 and all(left < met / 4 and not lost for met, left, lost in shown)
