import collections
import random

import pytest
from pyspark.sql import functions as F

from lexiweave.operators.hot_keys import Merge, tree_aggregate
from lexiweave.session import at_most, skew_join


@pytest.mark.parametrize("chunk_rows, fan_in, parts", [(7, 2, 5), (1, 3, 2), (65536, 16, 1), (50, 4, 30)])
def test_against_counting(spark, chunk_rows, fan_in, parts):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 9)])) for _ in range(400)]
    d = spark.createDataFrame([(*r, "c") for r in rows], "k string, v int, n string").repartition(parts)
    got = tree_aggregate(
        d, ["k"], [Merge("n", F.lit(1)), Merge("lo", F.col("v"), "min"), Merge("hi", F.col("v"), "max"), Merge("s", F.col("v"))], chunk_rows, fan_in
    )
    by = collections.defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    some = lambda x: [y for y in x if y is not None]
    want = {k: (len(v), min(some(v)), max(some(v)), sum(some(v))) for k, v in by.items()}
    assert {r.k: (r.n, r.lo, r.hi, r.s) for r in got.collect()} == want


def test_empty_and_wrong_sizes(spark):
    d = spark.createDataFrame([], "k string")
    assert tree_aggregate(d, ["k"], [Merge("n", F.lit(1))]).count() == 0
    with pytest.raises(ValueError):
        tree_aggregate(d, ["k"], [], fan_in=1)


def test_skew_join_is_a_join(spark):
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(300)] + [(None, -1)], "k int, i int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 300, 4)] + [(1, "one")], "k int, r string")
    for how in ("left", "inner"):
        a = sorted(map(str, skew_join(left, right, ["k"], how).select("k", "i", "r").collect()))
        assert a == sorted(map(str, left.join(right, ["k"], how).select("k", "i", "r").collect()))
    assert at_most(left, 301) and not at_most(left, 300)


def test_only_hot_keys_climb_the_tree(spark):
    """A hot key and a hot null key among many keys of one row, over more chunks than the fan-in."""
    rows = [(None if i % 5 == 1 else "hot" if i % 5 < 4 else f"k{i}", i) for i in range(2000)]
    d = spark.createDataFrame(rows, "k string, _hot int").repartition(6)
    got = {r.k: (r.n, r.last) for r in tree_aggregate(d, ["k"], [Merge("n", F.lit(1)), Merge("last", F.col("_hot"), "max")], 10, 3).collect()}
    assert got["hot"] == (1200, 1998) and got[None] == (400, 1996) and len(got) == 402 and all(v[0] == 1 for k, v in got.items() if k not in ("hot", None))
