"""Every core query against its SQL twin."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexiweave.plans import core_queries


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def text(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(text, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", core_queries())
def test_query(spark, sf, con, name):
    run, sql = core_queries()[name]
    d = run(spark, sf)
    cols = sorted(d.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in d.collect())
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(text(x[names.index(c)]) for c in cols) for x in r.fetchall())


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["query", "category", "votes"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core_queries()) <= set(entry.queries())
