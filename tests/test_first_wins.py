"""Keyed state over several micro-batches and restarts, against a plain loop."""

import datetime as dt
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from wiregrid.streaming import first_wins

SCHEMA = "id string, arrived timestamp, seq long, extra string"
START = dt.datetime(2024, 1, 1)


def taken(rows, horizon):
    last, out = {}, []
    for name, hour, seq, extra in sorted(rows, key=lambda r: (r[1], r[2])):
        if name not in last or hour - last[name] >= horizon:
            last[name] = hour
            out.append((name, hour, seq, extra))
    return sorted(out)


def run(spark, tmp_path, batches, hours):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, batch in enumerate(batches):
        rows = [(n, START + dt.timedelta(hours=h), s, x) for n, h, s, x in batch]
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        passed = first_wins.first_within(stream, "arrived", "seq", horizon=hours * 3600)
        query = first_wins.start(passed, out, str(tmp_path / "checkpoint"))
        query.awaitTermination()
    found = spark.read.schema(SCHEMA).parquet(out).select(
        "id", (F.unix_seconds("arrived") / 3600).cast("long").alias("h"), "seq", "extra"
    )
    zero = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) // 3600
    return sorted((r["id"], r["h"] - zero, r["seq"], r["extra"]) for r in found.collect())


def test_batches_with_restarts(spark, tmp_path):
    draw = random.Random(4)
    batches = [
        [(f"k{draw.randint(0, 9)}", draw.randint(8 * i, 8 * i + 7), 1000 * i + k, None)
         for k in range(40)]
        for i in range(4)
    ]
    batches[2] += [("hot", 17, 10**6 + k, "x") for k in range(3000)]
    batches[3] += batches[3][:5]
    found = run(spark, tmp_path, batches, 5)
    told = taken([r for b in batches for r in b], 5)
    assert found == told and len(found) > 30


def test_state_ends_with_the_horizon(spark, tmp_path):
    """An id sent again after the horizon passes, though its state was dropped in between."""
    batches = [[("a", 0, 0, None)], [("b", 30, 1, None)], [("c", 60, 2, None)], [("a", 61, 3, None)]]
    assert run(spark, tmp_path, batches, 10) == [
        ("a", 0, 0, None), ("a", 61, 3, None), ("b", 30, 1, None), ("c", 60, 2, None),
    ]


class Handle:
    """Counts the calls that would cross to the JVM."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return getattr(Handle, f"_{name}")(self, *args)

        return call

    def _getValueState(self, name, schema):
        return self

    def _exists(self):
        return self.value is not None

    def _get(self):
        return self.value

    def _update(self, value):
        self.value = value

    def _listTimers(self):
        return iter(self.timers)

    def _deleteTimer(self, at):
        self.timers.remove(at)

    def _registerTimer(self, at):
        self.timers.add(at)


def test_an_id_takes_few_state_calls_and_keeps_one_timer():
    handle = Handle()
    wins = first_wins.FirstWins("arrived", "seq", 3_600_000_000)
    wins.init(handle)

    def passed(*rows):
        handle.calls = 0
        made = [Row(arrived=START + dt.timedelta(minutes=m), seq=s) for m, s in rows]
        return [r.seq for r in wins.handleInputRows(("a",), iter(made), None)]

    assert passed((0, None), (0, 7), (0, 4), (30, 1)) == [4]
    assert handle.calls == 3 and len(handle.timers) == 1
    assert passed((59, 2)) == [] and handle.calls == 1
    assert passed((61, 9), (60, 8), (125, 3)) == [8, 3]
    assert handle.calls == 4 and len(handle.timers) == 1
