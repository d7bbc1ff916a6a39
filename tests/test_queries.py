"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import datetime
import os

import duckdb
import pytest

from seqloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, isinstance(x, str), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    cur = oracle.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    assert ordered(rows) == ordered(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
