"""Every registered query with SQL against DuckDB on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from doclens.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    want = duck.execute(Q.SQL[name])
    columns, truth = [d[0] for d in want.description], want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, truth)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0
