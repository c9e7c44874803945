"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon, duck_rows, loose, spark_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    want = duck_rows(duck, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canon(got), canon(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert loose(x, y), (name, x, y)
