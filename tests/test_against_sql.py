"""Every registered query against its DuckDB statement, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from oracle.sql import SQL
from rankloom.catalog import QUERIES
from rankloom.sources.derived import Derived

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](Derived(spark, FOLDER))
    got = df.collect()
    if name in SQL:
        cur = con.execute(SQL[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert table(got, df.columns) == table(cur.fetchall(), cols)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
