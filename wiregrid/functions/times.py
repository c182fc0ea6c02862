"""Time expressions; the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unix seconds of 0001-01-01 and 9999-12-31, the range of a timestamp.
MIN_UNIX, MAX_UNIX = -62135596800, 253402300799


def unix_in_range(seconds: Column) -> Column:
    return seconds.between(MIN_UNIX, MAX_UNIX)


def unix_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def timestamp_to_unix(ts: Column) -> Column:
    """Whole seconds, fractions dropped toward zero."""
    return F.call_function("div", F.unix_micros(ts), F.lit(1_000_000))


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM dd, yyyy")


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; null while either is missing."""
    return F.timestamp_diff("MILLISECOND", start, end)
