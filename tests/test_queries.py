"""Every registered query against its SQL in DuckDB, on the whole smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from workload import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("events", "region"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(SQL)
    assert set(SQL) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert 0 < __spark_entry__.entry(spark).count() <= 7


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns

    def ordered(rows):
        return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])

    order = [expected.columns.index(c) for c in columns]
    want = [tuple(row[i] for i in order) for row in expected.fetchall()]
    got = [tuple(row[c] for c in columns) for row in found.collect()]
    assert ordered(got) == ordered(want)
