"""Every query of the core against its SQL on the smallest tables, where those are at hand."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = [n for r in entry._registries() if r.__class__ and "llm" not in next(iter(r.queries.values())).__module__ for n in r.queries]


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = [tuple(plain(v) for v in r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
