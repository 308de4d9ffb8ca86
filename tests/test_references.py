from datetime import datetime as dt

import pytest

from lexiweave.operators.references import key_states, unresolved_references


def states(spark):
    p = spark.createDataFrame(
        [(1, 0, "a", dt(2020, 1, 1)), (1, 0, "a", dt(2019, 1, 1)), (2, 14, "b", dt(2020, 1, 1)), (3, 14, None, dt(2020, 1, 1)), (4, 14, "d", None)],
        "id bigint, ns int, title string, load_ts timestamp_ntz",
    )
    d = spark.createDataFrame(
        [(2, 14, "b", dt(2020, 1, 1), dt(2020, 2, 1)), (2, 14, "b", dt(2021, 1, 1), None), (5, 14, "e", dt(2020, 1, 1), None), (4, 14, "d", dt(2020, 1, 1), dt(2020, 1, 2))],
        "id bigint, ns int, title string, deleted_ts timestamp_ntz, restored_ts timestamp_ntz",
    )
    return key_states(p, d, ["ns", "title"], "id")


def refs(spark):
    return spark.createDataFrame(
        [(1, 0, "a", dt(2018, 1, 1)), (2, 0, "a", dt(2019, 6, 1)), (3, 14, "b", dt(2022, 1, 1)), (4, 14, "e", dt(2022, 1, 1)), (5, 14, "zz", None), (6, 14, None, None),
         (7, None, None, None), (8, 7, None, None), (9, 0, "a", None), (10, None, "a", None), (5, 14, "zz", None), (11, 14, "d", dt(2000, 1, 1))],
        "k int, ns int, title string, load_ts timestamp_ntz",
    )


@pytest.mark.parametrize(
    "match, more", [("simple", set()), ("partial", {(8, "missing")}), ("full", {(6, "partial_null"), (8, "partial_null"), (10, "partial_null")})]
)
def test_match_semantics(spark, match, more):
    got = unresolved_references(refs(spark).withColumnRenamed("load_ts", "seen"), states(spark), ["ns", "title"], "seen", match)
    rows = [(r.k, r.reason) for r in got.collect()]
    assert set(rows) == {(1, "late"), (3, "deleted"), (4, "deleted"), (5, "missing")} | more and rows.count((5, "missing")) == 2


def test_empty_tables(spark):
    none = states(spark).limit(0)
    got = unresolved_references(refs(spark), none, ["ns", "title"], "load_ts")
    assert {r.reason for r in got.collect()} == {"missing"}
    assert unresolved_references(refs(spark).limit(0), states(spark), ["ns", "title"]).count() == 0


def test_hot_key(spark):
    r = spark.createDataFrame([(i, 14 if i % 3 else 0, "b" if i % 3 else f"t{i}", dt(2022, 1, 1)) for i in range(900)], "k int, ns int, title string, load_ts timestamp_ntz")
    got = unresolved_references(r, states(spark), ["ns", "title"], "load_ts")
    assert got.filter("reason = 'deleted'").count() == 600 and got.filter("reason = 'missing'").count() == 300


def test_clashing_columns_are_kept_or_replaced(spark):
    r = refs(spark).selectExpr("*", "'old' as reason", "1 as present", "2 as deleted")
    got = unresolved_references(r, states(spark), ["ns", "title"], "load_ts")
    assert got.columns == ["k", "ns", "title", "load_ts", "present", "deleted", "reason"] and {x.reason for x in got.collect()} == {"late", "deleted", "missing"}


def test_unknown_match(spark):
    with pytest.raises(ValueError):
        unresolved_references(refs(spark), states(spark), ["ns", "title"], match="loose")
