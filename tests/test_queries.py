"""Every query with a SQL twin gives the same rows on the small tables."""

import os

import duckdb
import pytest

from tidemark.plans import io_queries, model_queries, queries

SF = "/root/testdata/sf0.001"
ALL = {**queries.QUERIES, **io_queries.QUERIES, **model_queries.QUERIES}
SQL = {**queries.ORACLES, **io_queries.ORACLES, **model_queries.ORACLES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return f"{float(value) + 0.0:.11g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = ALL[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())
