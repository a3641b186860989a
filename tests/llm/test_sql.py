"""Queries of the subpackage give the same rows as their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tandemtext.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(row):
    return tuple(repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    cur = duck.execute(queries.SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in got.columns]
    assert len(at) == len(cur.description)
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    assert sorted(map(plain, got.collect())) == sorted(map(plain, want))
