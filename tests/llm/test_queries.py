"""Registered queries of this subpackage against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from wiregrid.llm import queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{FOLDER}/{name_}.parquet'")
    told = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    found = queries.queries()[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(columns)
    got = sorted(map(tuple, found.select(columns).collect()))
    assert got == sorted(told.fetchall()) and got
