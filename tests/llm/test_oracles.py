"""Queries that SQL can express against DuckDB, on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from flowsieve.llm import oracles, queries

SF = "/root/testdata/sf0.01"
SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("benchmark", "conversations", "documents", "embeddings", "pages"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = queries.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
    assert rows == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=str)


def test_all_thirteen_are_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(SQL) <= set(names)
