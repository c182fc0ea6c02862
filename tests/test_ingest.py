import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wiregrid.functions import times
from wiregrid.operators import keyed
from wiregrid.operators.clusters import cluster_articles
from wiregrid.operators.normalize import (
    counts_per_ticker,
    feed_order,
    normalize,
    parse_raw,
    trailing_window,
)
from wiregrid.plans import catalog
from wiregrid.sources import derived, landing, tables
from wiregrid.streaming.ingest import ingest_new, recent_only

SAMPLE = {
    "headline": "Apple hits record high", "summary": "AAPL stock surged today.",
    "source": "Reuters", "url": "https://reuters.com/aapl", "datetime": 1700000000, "id": 1001,
}


def raw(spark, *records, ticker="AAPL"):
    rows = [(ticker, i, r if isinstance(r, str) else json.dumps(r), i) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "ticker string, batch_pos int, raw_json string, seq long")


def test_sample_article(spark):
    found = normalize(raw(spark, SAMPLE)).articles.first()
    assert found["id"] == "f75a5218c68d2dec"
    assert found["published_at"] == datetime.fromtimestamp(1700000000)
    assert (found["headline"], found["source"]) == ("Apple hits record high", "Reuters")
    assert json.loads(found["raw_json"]) == SAMPLE


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"datetime": None}, "datetime not an integer"),
        ({"datetime": "17.5"}, "datetime not an integer"),
        ({"datetime": "x"}, "datetime not an integer"),
        ({"datetime": 10**14}, "datetime out of range"),
        ({"source": 5}, "source not text"),
        ({"headline": ["a"]}, "headline not text"),
        ({"summary": {"a": 1}}, "summary not text"),
        ({"datetime": " 17 "}, None),
        ({"datetime": 17.9}, None),
        ({"headline": None, "summary": 0, "source": "", "url": False}, None),
    ],
)
def test_typing_rules(spark, change, reason):
    row = parse_raw(raw(spark, {**SAMPLE, **change})).first()
    assert row["reason"] == reason
    if "headline" in change and reason is None:
        assert row["headline"] == row["summary"] == row["source"] == row["url"] == ""


def test_rejects_do_not_stop_the_rest(spark):
    batch = raw(spark, {"headline": "No datetime field"}, SAMPLE, "{bad", '"text"', "null")
    found = normalize(batch)
    assert found.articles.count() == 1
    assert [r["reason"] for r in found.rejects.orderBy("batch_pos").collect()] == [
        "datetime missing", "not JSON", "not an object", "not an object",
    ]


def test_markup_in_a_headline(spark):
    found = normalize(raw(spark, {**SAMPLE, "headline": "<b>Apple</b> hits <i>record</i> high"}))
    assert found.articles.first()["headline"] == "Apple hits record high"


def test_trailing_window_includes_both_ends(spark):
    times = ["2024-01-01 11:59:59", "2024-01-01 12:00:00", "2024-01-02 12:00:00", "2024-01-02 12:00:01"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp"))
    as_of = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert trailing_window(df, "t", as_of).count() == 2


def test_counts_name_every_watched_ticker(spark):
    watched = spark.createDataFrame([("A", 0), ("B", 1)], "ticker string, position int")
    batch = spark.createDataFrame([("A",), ("A",), ("C",)], "ticker string")
    rows = counts_per_ticker(batch, watched).orderBy("position").collect()
    assert [(r["ticker"], r["fetched"]) for r in rows] == [("A", 2), ("B", 0)]


def test_json_files(spark, tmp_path):
    (tmp_path / "AAPL_2024-01-02.json").write_text(json.dumps([SAMPLE, {"x": 1}], indent=2))
    (tmp_path / "MSFT_2024-01-02.json").write_text("[]")
    (tmp_path / "NVDA_2024-01-02.json").write_text("not json")
    (tmp_path / "notes.txt").write_text("ignored")
    read = landing.read_json_batches(spark, str(tmp_path))
    rows = read.orderBy("ticker", "batch_pos").collect()
    assert [(r["ticker"], str(r["fetch_date"]), r["batch_pos"]) for r in rows] == [
        ("AAPL", "2024-01-02", 0), ("AAPL", "2024-01-02", 1), ("NVDA", "2024-01-02", 0),
    ]
    made = normalize(read.withColumn("seq", F.lit(0)))
    assert ("NVDA", "not json") in [(r["ticker"], r["raw_json"]) for r in made.rejects.collect()]
    assert json.loads(rows[0]["raw_json"]) == SAMPLE


def test_a_large_batch_comes_in_many_files(spark, monkeypatch):
    monkeypatch.setattr(landing, "FILE_ROWS", 50)
    monkeypatch.setattr(landing, "FILE_BYTES", 1000)
    rows = [("A" if i % 7 else "B", i, json.dumps({"i": i, "t": "x" * (i % 90)})) for i in range(400)]
    batch = spark.createDataFrame(rows, "ticker string, batch_pos int, raw_json string")
    files = landing.batch_files(batch, "2024-01-02")
    sizes = [(len(r["value"]), r["value"].count('"i"')) for r in files.collect()]
    assert len(sizes) > 16
    assert all(size < 1000 + 200 and n <= 50 for size, n in sizes)
    assert files.select("name").distinct().count() == len(sizes)
    read = landing.explode_batches(files, F.col("name")).collect()
    assert {str(r["fetch_date"]) for r in read} == {"2024-01-02"} and not any(r["is_file"] for r in read)
    read.sort(key=lambda r: (r["ticker"], r["batch_pos"]))
    got = [(r["ticker"], json.loads(r["raw_json"])) for r in read]
    assert got == [(t, json.loads(r)) for t, _, r in sorted(rows)]
    assert len({(r["ticker"], r["batch_pos"]) for r in read}) == len(rows)


def landed(spark, ticker, day, *records):
    rows = [(ticker, day, i, json.dumps(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "ticker string, d string, batch_pos int, raw_json string")
    return df.select("ticker", F.col("d").cast("date").alias("fetch_date"), "batch_pos", "raw_json")


def test_landing_replaces_days_and_keeps_others(spark, tmp_path):
    path = str(tmp_path / "landing")
    landing.write_landing(landed(spark, "A", "2024-01-02", SAMPLE, SAMPLE), path)
    landing.write_landing(landed(spark, "B", "2024-01-02", SAMPLE), path)
    asked = landed(spark, "A", "2024-01-02", SAMPLE).select("ticker", "fetch_date")
    landing.write_landing(landed(spark, "A", "2024-01-02", SAMPLE).limit(0), path, asked)
    assert landing.read_landing(spark, path, ticker="A").count() == 0
    assert landing.read_landing(spark, path, days=("2024-01-02", "2024-01-02")).count() == 1


def test_stream_keeps_the_first_record_for_good(spark, tmp_path):
    path, store, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "checkpoint"))
    watched = spark.createDataFrame([("A", 0), ("B", 1)], "ticker string, position int")

    def run():
        ingest_new(spark, path, watched, store, checkpoint).awaitTermination()
        stored = tables.read_appended(spark, store, "articles").orderBy("published_at")
        return [(r["ticker"], r["headline"]) for r in stored.collect()]

    other = {**SAMPLE, "datetime": 1700000060}
    landing.write_landing(
        landed(spark, "A", "2024-01-02", SAMPLE, {**SAMPLE, "headline": "again"}), path
    )
    assert run() == [("A", "Apple hits record high")]
    landing.write_landing(
        landed(spark, "A", "2024-01-03", {**SAMPLE, "headline": "later"}, other, {"bad": 1}), path
    )
    expected = [("A", "Apple hits record high"), ("A", "Apple hits record high")]
    assert run() == expected
    assert run() == expected


def test_every_record_is_stored_or_set_aside(spark, tmp_path):
    path, store, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "checkpoint"))
    watched = spark.createDataFrame([("A", 0)], "ticker string, position int")
    for ticker in ("A", "other", None):
        again = {**SAMPLE, "url": str(ticker)}
        landing.write_landing(landed(spark, ticker, "2024-01-02", again, {"bad": 1}), path)
    ingest_new(spark, path, watched, store, checkpoint).awaitTermination()
    assert [r["ticker"] for r in tables.read_appended(spark, store, "articles").collect()] == ["A"]
    rejects = tables.read_appended(spark, store, "article_rejects").collect()
    assert {(r["ticker"], r["batch_pos"], r["reason"]) for r in rejects} == {
        ("A", 1, "datetime missing"), ("other", 1, "datetime missing"), (None, 1, "datetime missing"),
        ("other", 0, "ticker not watched"), (None, 0, "ticker missing"),
    }


@pytest.mark.parametrize("name", ["raw_ingest", "stream_ingest", "stored_rejects"])
def test_sources_are_read_from_the_data(spark, tmp_path, name):
    rows = [(i, f"host{i % 30}", "es" if i % 3 else "en", f"text {i}") for i in range(90)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()[name](spark, str(tmp_path)).collect()
    expected = {f"host{i % 30}" for i in range(90) if bool(i % 3) == (name == "stored_rejects")}
    assert {r["ticker"] for r in found} == expected
    assert len(found) == (60 if name == "stored_rejects" else 30)


def test_watchlist_positions_are_dense(spark):
    sources = [(f"s{i % 500}" if i % 9 else None,) for i in range(5000)]
    watched = derived.watchlist_of(spark.createDataFrame(sources, "source string")).collect()
    assert sorted(r["position"] for r in watched) == list(range(500))
    assert len({r["ticker"] for r in watched}) == 500


def test_feed_order_has_room(spark):
    places = [("2024-01-02", 0, 5), ("2024-01-02", 40_000, 0), ("2024-01-03", 0, 0)]
    df = spark.createDataFrame(places, "d string, position int, batch_pos int")
    made = df.select(feed_order(F.col("d").cast("date"), F.col("position"), F.col("batch_pos")))
    seqs = [r[0] for r in made.collect()]
    assert seqs == sorted(set(seqs))
    with pytest.raises(Exception, match="out of range"):
        df.select(feed_order(F.lit("2024-01-02").cast("date"), F.lit(1 << 20), F.lit(0))).collect()


def test_a_large_batch_keeps_its_order(spark, tmp_path):
    """Places beyond 24 bits in stored articles, and what clusters make of them."""
    places = [("A", 16_777_216), ("B", 5), ("A", 2**31 - 1), ("A", 16_777_215)]
    rows = [
        (t, p, json.dumps({**SAMPLE, "headline": f"{t} same words here", "url": f"{t}{p}"}))
        for t, p in places
    ]
    batch = spark.createDataFrame(rows, "ticker string, batch_pos int, raw_json string").withColumn(
        "fetch_date", F.lit("2024-01-02").cast("date")
    )
    watched = spark.createDataFrame([("A", 0), ("B", 1)], "ticker string, position int")
    made = normalize(landing.in_feed_order(batch, watched))
    tables.append_new(made.articles, str(tmp_path), "articles", 0, "seq", within="published_at")
    stored = tables.read_appended(spark, str(tmp_path), "articles")
    urls = [r["url"] for r in stored.orderBy("seq").collect()]
    assert urls == ["A16777215", "A16777216", "A2147483647", "B5"]
    clusters, members = cluster_articles(stored)
    assert [r["article_count"] for r in clusters.collect()] == [4]
    ids = {r["id"]: r["url"] for r in stored.collect()}
    assert [ids[r["article_id"]] for r in members.orderBy("member_pos").collect()] == urls


def test_late_first_record_is_kept(spark, tmp_path):
    """An old article that arrives for the first time in a later micro-batch passes."""
    source, rows = tmp_path / "in", [("new", 10), ("filler", 12), ("late", 1), ("new", 10)]
    schema = "id string, published_at timestamp"
    for i, (name, day) in enumerate(rows):
        spark.createDataFrame([(name, f"2024-02-{day:02}")], "id string, d string").select(
            "id", F.col("d").cast("timestamp").alias("published_at")
        ).coalesce(1).write.mode("append").parquet(f"{source}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = (
        recent_only(stream).writeStream.format("memory").queryName("late_first")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.table("late_first").collect()) == ["filler", "late", "new"]


def test_updates_of_one_key_do_not_multiply(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    made = keyed.update_by_key(stored, updates, ["k"], ["v"]).collect()
    assert sorted(map(tuple, made)) == [(1, "y"), (2, "b")]


def test_empty_snapshot_is_the_newest(spark, tmp_path):
    store = str(tmp_path)
    rows = spark.createDataFrame([("c", 0, "a")], "cluster_id string, member_pos int, article_id string")
    tables.write_snapshot(rows, store, "cluster_members", 1)
    tables.write_snapshot(rows.where("false"), store, "cluster_members", 2)
    assert tables.read_snapshot(spark, store, "cluster_members").count() == 0
    assert tables.read_snapshot(spark, store, "cluster_members", 1).count() == 1
    assert tables.read_snapshot(spark, store, "cluster_members", 3, exact=True).count() == 0


def test_seconds_are_exact_in_far_years(spark):
    df = spark.sql("SELECT timestamp '9999-12-31 23:59:58.999999' AS t UNION ALL SELECT timestamp '1969-12-31 23:59:58.5'")
    got = sorted(r[0] for r in df.select(times.timestamp_to_unix(F.col("t"))).collect())
    assert got == [-1, 253402300798]
