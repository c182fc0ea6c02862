"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
from wiregrid.plans import catalog, oracle

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def comparable(rows):
    return sorted(
        tuple(
            "" if v is None else f"{v:.9g}" if isinstance(v, float) else f"{type(v).__name__} {v}"
            for v in row
        )
        for row in rows
    )


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_oracle(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    told = duck.execute(registry.oracle_sql()[name])
    named = [d[0] for d in told.description]
    expected = told.fetchall()
    assert sorted(named) == columns
    places = [named.index(c) for c in columns]
    got = [tuple(row) for row in found.select(columns).collect()]
    assert got or name in ("article_rejects",)
    assert comparable(got) == comparable([tuple(row[i] for i in places) for row in expected])


def test_entry(spark):
    assert registry.entry(spark).count() == 5
