"""Every query with SQL equals DuckDB on the small tables; the others return rows."""

import os

import duckdb
import pytest

from stateloom.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(want.fetchall(), columns)
