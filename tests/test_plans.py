"""Every query with SQL, on Spark and on DuckDB, over whole tables."""

import decimal
import glob
import os

import pytest

from textloom.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return v if not isinstance(v, float) else round(v, 6) + 0.0


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck, sf):
    df = catalog.queries()[name](spark, sf)
    want = duck.sql(SQL[name])
    a, b = table(df.columns, [tuple(r) for r in df.collect()]), table(want.columns, want.fetchall())
    assert a[0] == b[0]
    assert a[1] == b[1]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(name, spark, sf):
    df = catalog.queries()[name](spark, sf)
    assert df.columns and df.count() > 0
