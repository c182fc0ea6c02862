"""Snapshots that share their unchanged buckets."""

import os

from pyspark.sql import functions as F

from wiregrid.sources import buckets

SCHEMA = "k string, n int, value string"


def files(root, version):
    folder = f"{root}/t/version={version}"
    return sorted(
        (name, f) for name in os.listdir(folder) if name.startswith("bucket=")
        for f in os.listdir(f"{folder}/{name}") if f.endswith(".parquet")
    ) if os.path.isdir(folder) else []


def test_a_small_batch_rewrites_its_buckets_only(spark, tmp_path):
    root = str(tmp_path)
    first = spark.range(2000).select(
        F.concat(F.lit("k"), "id").alias("k"), F.lit(0).alias("n"), F.lit("old").alias("value")
    ).unionByName(spark.createDataFrame([(None, 0, "old")], SCHEMA))

    def merge(rows, version):
        made = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
        return buckets.merge(made, root, "t", version, ["k"], [F.desc("n")], buckets=16)

    def held(snapshot=None):
        got = buckets.read(spark, root, "t", first.schema, snapshot).collect()
        assert len({r.k for r in got}) == len(got)
        return {r.k: r.value for r in got}

    assert held() == {}
    assert merge(first, 0) == list(range(16))
    before = len(files(root, 0))
    touched = merge([("k7", 1, "older"), ("k7", 2, "new")], 1)
    assert len(touched) == 1 and len(files(root, 1)) == 1 and before >= 16
    assert held()["k7"] == "new" and held(0)["k7"] == "old" and len(held()) == 2001
    # A null key, a new key, and a version written again.
    merge([(None, 1, "wrong")], 2)
    merge([(None, 1, "new"), ("other", 1, "new")], 2)
    assert held()[None] == "new" and len(held()) == 2002 and held(1)[None] == "old"
    # Nothing new; and a write without its manifest, which is not read.
    assert merge([], 3) == [] and len(held()) == 2002
    spark.createDataFrame([("lost", 1, "x", 1)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(
        f"{root}/t/version=9"
    )
    assert "lost" not in held() and held(0)["k7"] == "old"


def test_a_table_that_begins_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert buckets.merge(none, str(tmp_path), "t", 0, ["k"], [F.desc("n")]) == []
    assert buckets.read(spark, str(tmp_path), "t", none.schema).count() == 0
    buckets.merge(spark.createDataFrame([("a", 1, "x")], SCHEMA), str(tmp_path), "t", 1, ["k"], [F.desc("n")])
    assert buckets.read(spark, str(tmp_path), "t", none.schema).count() == 1
