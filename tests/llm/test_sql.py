"""Queries with SQL, on Spark and on DuckDB, over whole tables."""

import glob
import os

import duckdb
import pytest

from textloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, want = queries.queries()[name](spark, sf), c.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect()), key=repr) == sorted(want.project(", ".join(cols)).fetchall(), key=repr)
