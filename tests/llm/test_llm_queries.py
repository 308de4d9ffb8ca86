"""The training-data queries: against their SQL twins where there are any, else their columns and size."""

import os

import duckdb
import pytest

from lexiweave.llm.queries import QUERIES

COLUMNS = {
    "p1_found": ["w_id_a", "w_id_b"], "p2_found": ["doc_id", "subject"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "pii_type", "pii_text"],
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, name):
    run, sql = QUERIES[name]
    d = run(spark, sf)
    rows = d.collect()
    assert rows and d.columns == COLUMNS.get(name, d.columns) and (name not in COLUMNS or len(set(rows)) == len(rows))
    if sql:
        c = duckdb.connect()
        for f in os.listdir(sf):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(map(str, (tuple(x[k] for k in names) for x in rows))) == sorted(map(str, r.fetchall()))


def test_pairs_are_ordered(spark, sf):
    assert all(r.w_id_a < r.w_id_b for r in QUERIES["p1_found"][0](spark, sf).collect())
