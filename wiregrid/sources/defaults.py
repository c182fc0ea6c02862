"""Typed rows from loosely typed ones: the defaults that a stored table is read with.

Stores that keep everything as text or numbers hand over nulls, 0 and 1 for
booleans, ISO texts for times and JSON texts for lists. `typed` reads them as a
table's columns: a null text is empty, a missing flag false, a missing list
empty, a digest without a status composed. A time without a zone is UTC. What
cannot be read as its column's type (a time that is none, a list that is no
JSON array) is null for times and empty for lists; it is no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    StringType,
    StructType,
    TimestampType,
)

# What stands for a missing value of a column, where it is not its type's default.
DEFAULTS = {"status": "composed", "event_type": "other", "confidence": "low"}


def _flag(value: Column) -> Column:
    shown = F.lower(F.trim(value.cast("string")))
    return F.coalesce(shown.isin("1", "true", "1.0"), F.lit(False))


def _list(value: Column, kind: ArrayType) -> Column:
    none = F.array().cast(kind)
    return F.coalesce(F.from_json(value, kind.simpleString()), none)


def column_of(value: Column, given: DataType, kind: DataType, name: str) -> Column:
    """A column of type `given` as one of type `kind`, with the default of `name`."""
    if isinstance(kind, BooleanType):
        return _flag(value)
    if isinstance(kind, StringType):
        return F.coalesce(value.cast("string"), F.lit(DEFAULTS.get(name, "")))
    if isinstance(kind, ArrayType):
        if isinstance(given, ArrayType):
            return F.coalesce(value.cast(kind), F.array().cast(kind))
        return _list(value, kind)
    if isinstance(kind, (TimestampType, DateType)):
        shown = F.trim(value) if isinstance(given, StringType) else value
        return shown.try_cast("timestamp").cast(kind)
    return value.try_cast(kind)


def typed(rows: DataFrame, schema: StructType) -> DataFrame:
    """`rows` as `schema` has them; columns that are missing hold their defaults."""
    out = []
    for f in schema.fields:
        given = rows.schema[f.name].dataType if f.name in rows.columns else StringType()
        value = F.col(f.name) if f.name in rows.columns else F.lit(None).cast("string")
        out.append(column_of(value, given, f.dataType, f.name).alias(f.name))
    return rows.select(*out)
