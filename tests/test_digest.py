from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wiregrid.operators import digest, keyed, ledger, watchlists
from wiregrid.operators.rank import in_order, rank_in_group
from wiregrid.operators.score import python_scorer
from wiregrid.operators.summaries import summarize
from wiregrid.plans.daily import DailyRun, load_all
from wiregrid.sources import defaults, tables

CLUSTER = "cluster_id string, cluster_seq long, ticker string, representative_headline string, article_count long"


def summary_of(spark, rep, *members):
    """Summary of one cluster whose members are (headline, summary); None for a missing article."""
    clusters = spark.createDataFrame([("c", 0, "T", rep, len(members))], CLUSTER)
    links = spark.createDataFrame(
        [("c", i, f"a{i}") for i in range(len(members))] or [("other", 0, "x")],
        "cluster_id string, member_pos long, article_id string",
    )
    rows = [(f"a{i}", *m) for i, m in enumerate(members) if m]
    articles = spark.createDataFrame(rows, "id string, headline string, summary string")
    return summarize(clusters, links, articles).first()["summary"]


def test_summaries(spark):
    assert summary_of(spark, "Rep", ("Rep", "A longer text")) == "Rep A longer text"
    assert summary_of(spark, "Rep", ("Rep", "REP")) == "Rep"
    assert summary_of(spark, "Rep", ("Rep", "same"), ("other", "SAME")) == "Rep other (2 sources)"
    assert summary_of(spark, "Rep", ("Rep", "abc"), ("xyz", "")) == "Rep abc (2 sources)"
    assert summary_of(spark, "Rep", None) == "Rep"
    assert summary_of(spark, "", ("", "text")) == " text"
    long = summary_of(spark, "h" * 300, ("h" * 300, "s" * 300))
    assert long == "h" * 147 + "... " + "s" * 147 + "..."
    assert summary_of(spark, "h" * 500, None) == "h" * 397 + "..."


def context(spark, *rows):
    """Rows of (ticker, importance, article_count)."""
    return spark.createDataFrame(
        [
            (f"c{i}", i, t, f"head {i}", "sum" if n > 1 else "", n, "legal", imp, "", "", 0)
            for i, (t, imp, n) in enumerate(rows)
        ],
        "cluster_id string, cluster_seq long, ticker string, representative_headline string, "
        "summary string, article_count long, event_type string, importance_score int, "
        "url string, source string, age long",
    )


def test_context_takes_the_first_of_the_best(spark):
    clusters = spark.createDataFrame(
        [("c", 0, "T", "h", None), ("d", 1, "T", "h", "s")],
        "cluster_id string, cluster_seq long, ticker string, representative_headline string, summary string",
    )
    members = spark.createDataFrame(
        [("c", 0, "x"), ("c", 1, "y"), ("c", 2, "z"), ("d", 0, "none")],
        "cluster_id string, member_pos long, article_id string",
    )
    scores = spark.createDataFrame(
        [("x", "macro", 5, False), ("y", "legal", 40, True), ("z", "merger", 40, True)],
        "article_id string, event_type string, importance_score int, include_in_digest boolean",
    )
    c, d = digest.cluster_context(clusters, members, scores).orderBy("cluster_id").collect()
    assert (c["event_type"], c["importance_score"], c["article_count"], c["summary"]) == ("legal", 40, 3, "")
    assert (d["event_type"], d["importance_score"], d["article_count"]) == ("other", 0, 1)
    kept = digest.cluster_context(clusters, members, scores, only_included=True)
    assert [r["cluster_id"] for r in kept.collect()] == ["c"]


def test_top_sections_and_text(spark):
    ctx = context(spark, ("A", 10, 1), ("Z", 90, 1), ("A", 50, 3), ("A", 50, 1))
    watched = spark.createDataFrame([("A", 0), ("B", 1)], "ticker string, position int")
    top = digest.top_stories(ctx, 2)
    assert [r["cluster_id"] for r in top.orderBy("rank").collect()] == ["c1", "c2"]
    sections = digest.digest_sections(ctx, watched)
    got = [(r["ticker"], r["rank"], r["cluster_id"]) for r in sections.orderBy("position", "rank").collect()]
    assert got == [("A", 1, "c2"), ("A", 2, "c3"), ("A", 3, "c0"), ("B", 0, None)]
    limited = digest.digest_sections(ctx, watched, per_ticker_limit=1)
    assert limited.where(F.col("note").isNull()).count() == 1
    scores = spark.createDataFrame([(True,), (False,)], "include_in_digest boolean")
    metrics = digest.digest_metrics(ctx, scores)
    assert tuple(metrics.first()) == (6, 1, 4)
    as_of = F.lit("2024-03-05 07:08:09").cast("timestamp")
    lines = digest.digest_lines(top, sections, metrics, as_of)
    whole = digest.digest_text(lines).first()["text"]
    body = whole.split("\n")
    assert body[1] == "STOCK NEWS DIGEST — March 05, 2024"
    assert body[3] == "6 articles processed · 4 events · 1 relevant"
    start = body.index("--- A ---")
    assert body[start + 1 : start + 3] == ["• [LEGAL] head 2", "  sum  (3 sources)"]
    quiet = body.index("--- B ---")
    assert body[quiet + 1 : quiet + 3] == ["  No major updates in the last 24 hours.", ""]
    parts = digest.digest_text(lines, part_lines=7).orderBy("text_part").collect()
    assert len(parts) > 3 and "\n".join(p["text"] for p in parts) == whole


def test_an_empty_digest_still_lists_the_watchlist(spark):
    ctx = context(spark, ("A", 1, 1)).limit(0)
    watched = spark.createDataFrame([("A", 0), ("B", 1)], "ticker string, position int")
    assert digest.digest_sections(ctx, watched).count() == 2
    assert tuple(digest.digest_metrics(ctx, spark.createDataFrame([], "include_in_digest boolean")).first()) == (0, 0, 0)


def test_rank_crosses_blocks(spark):
    df = spark.range(0, 300_000, 7).select(
        (F.col("id") % 2).alias("g"), (F.col("id") % 3).alias("lead"), "id"
    )
    ranked = rank_in_group(df, ["g"], [-F.col("lead")], "id", "r")
    rows = sorted(ranked.collect(), key=lambda r: (r["g"], -r["lead"], r["id"]))
    for g in (0, 1):
        assert [r["r"] for r in rows if r["g"] == g] == list(range(sum(r["g"] == g for r in rows)))


def test_weighted_join_equals_a_plain_one(spark):
    left = spark.range(1000).select(
        F.when(F.col("id") < 600, 1).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    right = left.groupBy("k").agg(F.count("*").alias("w")).where("k <> 7").withColumn("v", F.col("k") * 2)
    for how in ("inner", "left"):
        got = keyed.join_weighted(left, right, "k", "w", 1000, how, heavy_rows_min=100)
        plain = left.join(right.drop("w"), "k", how)
        assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(
            map(str, plain.select("k", "id", "v").collect())
        )


LEDGER = "id string, version long, run_date date, status string, sent_at timestamp, recipient string"


def book(spark, *rows):
    day = datetime(2024, 1, 2).date()
    return spark.createDataFrame([(i, v, d or day, s, None, None) for i, v, d, s in rows], LEDGER)


def test_send_guard(spark):
    other = datetime(2024, 1, 1).date()
    runs = book(spark, ("d1", 1, None, "composed"), ("d1", 2, None, "sent"), ("d2", 3, None, "composed"),
                ("d3", 1, other, "composed"))
    fresh = runs.where("status = 'composed' and id <> 'd1'")

    def decide(**options):
        return {r["id"]: r["decision"] for r in ledger.send_decisions(fresh, runs, **options).collect()}

    assert decide() == {"d2": "skip", "d3": "send"}
    assert decide(force=True) == {"d2": "send", "d3": "send"}
    assert decide(dry_run=True) == {"d2": "hold", "d3": "hold"}
    assert ledger.latest_digest(runs).first()["id"] == "d2"
    assert ledger.digest_for_date(runs, F.lit("2024-01-01").cast("date")).first()["id"] == "d3"
    assert ledger.digest_for_date(runs, F.lit("1999-01-01").cast("date")).first() is None


def test_daily_run_end_to_end(spark, tmp_path):
    store = str(tmp_path / "store")
    watched = spark.createDataFrame([("AAPL", 0), ("TSLA", 1)], "ticker string, position int")
    as_of = datetime(2023, 11, 15, 12, 0, 0)
    record = '{"headline": "%s", "summary": "", "source": "s", "url": "%s", "datetime": 1700000000}'
    rows = [
        ("AAPL", 0, record % ("Apple earnings beat EPS and revenue guidance", "u1")),
        ("AAPL", 1, record % ("Apple earnings beat EPS and revenue guidance today", "u2")),
        ("TSLA", 0, record % ("Tesla recall", "u3")),
        ("TSLA", 1, "{broken"),
    ]
    raw = spark.createDataFrame(rows, "ticker string, batch_pos int, raw_json string").withColumn(
        "fetch_date", F.lit("2023-11-15").cast("date")
    )
    run = DailyRun(spark, store, watched, as_of, version=1)
    assert run.ingest(raw) and run.group() and run.compose(), run.steps
    assert tables.read_appended(spark, store, "articles").count() == 3
    assert tables.read_snapshot(spark, store, "event_clusters").count() == 2
    decisions = run.decide().collect()
    assert [r["decision"] for r in decisions] == ["send"]
    run.record(spark.createDataFrame(
        [(decisions[0]["id"], 2, True, as_of, "reader")],
        "id string, version long, delivered boolean, at timestamp, recipient string",
    ))
    assert [r["decision"] for r in run.decide().collect()] == ["skip"]
    assert run.finish() == "success"
    steps = tables.read_appended(spark, store, "run_logs").orderBy("step_order").collect()
    assert [r["step"] for r in steps] == [
        "fetch", "normalize", "score", "cluster", "summarize", "compose", "send", "pipeline"
    ]
    text = tables.read_appended(spark, store, "digest_texts").first()["text_content"]
    assert "--- TSLA ---" in text and "3 articles processed" in text
    tables.write_snapshot(
        tables.read_snapshot(spark, store, "event_clusters").withColumn(
            "cluster_id", F.concat(F.lit("old"), "cluster_id")
        ),
        store, "event_clusters", 0,
    )
    stored = load_all(spark, store)
    assert stored.clusters.count() == 4
    assert {r["age"] for r in stored.clusters.collect()} == {0, -1}
    bad = DailyRun(spark, store, watched, as_of, version=2)
    assert not bad.ingest(raw.drop("raw_json"))
    assert bad.finish() == "partial"


def test_digests_of_many_watchlists(spark):
    """Every watchlist's text is the one it would get alone; hot tickers and long lists included."""
    ctx = context(spark, *[(f"T{i % 6}", (i * 37) % 90, i % 3) for i in range(60)])
    scores = spark.createDataFrame([(True,), (False,)], "include_in_digest boolean")
    as_of = F.lit("2024-03-05 07:08:09").cast("timestamp")
    lists = {"hot": [], **{f"w{i}": ["T0", f"T{i % 6}", f"Q{i % 3}"] for i in range(20)}}
    lists["long"] = [f"T{i}" for i in range(6)] + [f"Q{i}" for i in range(30)]
    del lists["hot"]
    rows = [(name, t, i) for name, tickers in lists.items() for i, t in enumerate(dict.fromkeys(tickers))]
    rows += [("w1", "T0", 9), (None, "T0", 0), ("w2", None, 0)]
    entries = spark.createDataFrame(rows, watchlists.ENTRIES)
    for limit, sizes in ((None, dict(lists_per_salt=3, piece_lines=6, part_pieces=4)), (2, {})):
        parts = watchlists.digest_texts(ctx, scores, entries, as_of, per_ticker_limit=limit, **sizes)
        got = {}
        for r in sorted(parts.collect()):
            got.setdefault(r.watchlist_id, []).append(r.text)
        assert sorted(got) == sorted(lists)
        for name in ("w0", "w1", "w5", "long"):
            alone = [(t, i) for i, t in enumerate(dict.fromkeys(lists[name]))]
            sections = digest.digest_sections(ctx, spark.createDataFrame(alone, "ticker string, position int"), limit)
            lines = digest.digest_lines(
                digest.top_stories(ctx), sections, digest.digest_metrics(ctx, scores), as_of
            )
            assert "\n".join(got[name]) == digest.digest_text(lines).first()["text"], name
    assert sorted(got["w2"]) and "--- T0 ---" in got["w2"][0]
    made = watchlists.digest_rows(entries, as_of, 4).collect()
    assert len(made) == len(lists) == len({r.id for r in made})
    assert {(r.version, r.status) for r in made} == {(4, "composed")}
    assert watchlists.digest_texts(ctx, scores, entries.limit(0), as_of).count() == 0


def test_each_failure_is_a_step_of_its_own(spark, tmp_path):
    """A failing scorer leaves clusters and a digest; counters are those of the tables."""
    watched = spark.createDataFrame([("A", 0)], "ticker string, position int")
    as_of = datetime(2023, 11, 15, 12, 0, 0)
    record = '{"headline": "%s", "summary": "s", "source": "s", "url": "%s", "datetime": 1700000000}'
    rows = [("A", i, record % (f"Alpha beta gamma {i}", f"u{i}")) for i in range(5)] + [("A", 9, "{")]
    raw = spark.createDataFrame(rows, "ticker string, batch_pos int, raw_json string").withColumn(
        "fetch_date", F.lit("2023-11-15").cast("date")
    )
    calls = spark.sparkContext.accumulator(0)

    def score_one(article):
        calls.add(1)
        if article["headline"].endswith("3"):
            raise ValueError("unusable")
        return dict(is_relevant=True, relevance_score=0.5, importance_score=50, event_type="legal",
                    confidence="low", include_in_digest=True, reason="r")

    run = DailyRun(spark, str(tmp_path / "a"), watched, as_of, version=1)
    assert run.ingest(raw) and run.group(scorer=python_scorer(score_one)) and run.compose()
    assert calls.value == 5
    assert run.finish() == "success"
    log = tables.read_appended(spark, str(tmp_path / "a"), "run_logs").orderBy("step_order").collect()
    assert [r.step for r in log] == [
        "fetch", "normalize", "score", "cluster", "summarize", "compose", "pipeline"
    ]
    told = {r.step: r.message for r in log}
    assert "fetched=6" in told["fetch"] and "stored=5 rejected=1" in told["normalize"]
    assert "scored=4 rejected=1 flagged=4" in told["score"]
    assert "articles=5 clusters=1" in told["cluster"] and "summaries=1" in told["summarize"]
    assert run.counters["scored"] == tables.read_appended(spark, str(tmp_path / "a"), "article_scores").count()

    def broken(articles):
        raise RuntimeError("no scorer")

    run = DailyRun(spark, str(tmp_path / "b"), watched, as_of, version=1)
    assert run.ingest(raw) and not run.group(scorer=broken) and run.compose()
    assert tables.read_snapshot(spark, str(tmp_path / "b"), "event_clusters").count() == 1
    assert tables.read_appended(spark, str(tmp_path / "b"), "digest_runs").count() == 1
    assert run.finish() == "partial"
    run = DailyRun(spark, str(tmp_path / "c"), watched, as_of, version=1)
    lost = raw.withColumn("raw_json", F.raise_error(F.lit("gone")).cast("string"))
    assert not run.ingest(lost) and run.finish() == "failed"


def test_places_over_ranges(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("k"), "id").repartition(6)
    placed = in_order(df, [F.desc("k"), F.asc("id")], "place", parts=5).collect()
    told = sorted(((-r["k"], r["id"]) for r in placed))
    assert [(-r["k"], r["id"]) for r in sorted(placed, key=lambda r: r["place"])] == told
    assert sorted(r["place"] for r in placed) == list(range(5000))
    assert in_order(df.limit(0), [F.asc("id")], "place").count() == 0


def test_defaults_of_loose_rows(spark):
    schema = StructType.fromDDL(
        "a string, at timestamp, on boolean, ids array<string>, status string, n int, day date"
    )
    rows = [
        (None, "2024-01-02T03:04:05", 1, '["x", "y"]', None, "7", "2024-01-02"),
        ("t", " 2024-01-02 03:04:05+01:00 ", 0, None, "sent", None, None),
        ("", "never", None, "{broken", "", "x", "no day"),
    ]
    loose = spark.createDataFrame(rows, "a string, at string, on int, ids string, status string, n string, day string")
    one, two, three = defaults.typed(loose, schema).select("*", F.unix_seconds("at").alias("ts")).collect()
    assert (one.a, one.on, one.ids, one.status, one.n) == ("", True, ["x", "y"], "composed", 7)
    assert one.ts - two.ts == 3600 and (two.on, two.ids, two.status, two.n) == (False, [], "sent", None)
    assert (three.ts, three.on, three.ids, three.status, three.day) == (None, False, [], "", None)
    bare = defaults.typed(loose.select("a"), schema).first()
    assert (bare.at, bare.on, bare.ids, bare.status) == (None, False, [], "composed")
