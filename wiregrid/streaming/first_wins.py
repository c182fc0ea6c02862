"""First record of an id wins within a horizon, by keyed state with a timer per id."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

# Fixed value: the state store that keyed state with timers needs.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_MICRO = timedelta(microseconds=1)


def _micros(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=at.tzinfo and timezone.utc)) // _MICRO


def _rank(order) -> tuple:
    """A missing order is the last."""
    missing = order is None or order != order
    return missing, None if missing else order


class FirstWins(StatefulProcessor):
    """Passes a record unless one of its id passed less than `horizon` before it.

    The state of an id is when its last record passed. A timer drops it once the watermark lies a
    horizon later; by then no record can come that it would hold back.
    """

    def __init__(self, arrived: str, order: str, horizon: int):
        self.arrived, self.order, self.horizon = arrived, order, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "micros long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept: dict[datetime, Row] = {}  # a row per arrival: the first in order
        for row in rows:
            held = kept.setdefault(row[self.arrived], row)
            if _rank(row[self.order]) < _rank(held[self.order]):
                kept[row[self.arrived]] = row
        state = self.passed.get()
        before = last = state[0] if state else None
        for arrived in sorted(kept):
            at = _micros(arrived)
            if last is None or at - last >= self.horizon:
                yield kept[arrived]
                last = at
        if last != before:
            self.passed.update((last,))
            # A timer is told by what the state held. Every call crosses to the JVM.
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(last))

    def _ends(self, passed: int) -> int:
        return (passed + self.horizon) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.passed.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_within(
    records: DataFrame, arrived: str, order: str, key: str = "id", horizon: int = 86_400
) -> DataFrame:
    """The records of a stream that no record of their key held back, `horizon` in seconds.

    `arrived` is a timestamp, which the result follows in place of any clock; of records that
    arrived together the least `order` is the first. Records may come out of order by less than the
    horizon: of two that differ by less, the one that a micro-batch holds first wins; later ones
    than that Spark drops. Records without a key are one key's; those without an arrival are
    dropped. State is held for keys of the last two horizons; a task holds one row per arrival of a
    key in a micro-batch.
    """
    timed = records.where(F.col(arrived).isNotNull()).withWatermark(arrived, f"{horizon} seconds")
    return timed.groupBy(key).transformWithState(
        FirstWins(arrived, order, horizon * 1_000_000),
        outputStructType=records.schema,
        outputMode="Append",
        timeMode="EventTime",
    )


def start(passed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what `first_within` passes to a table, taking up where the checkpoint ends."""
    conf = passed.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        return (
            passed.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)
