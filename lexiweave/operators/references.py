"""References to records that do not exist (problem 4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import skew_join

MATCH = ("simple", "partial", "full")


def key_states(present: DataFrame, deletions: DataFrame | None, keys: Sequence[str], identity: str) -> DataFrame:
    """One row per target record: ``keys``, ``present``, ``deleted``, ``first_seen``.

    present: keys, identity, ``load_ts``; a record delivered several times counts once, with its
    earliest arrival. deletions: keys, identity, ``deleted_ts``, ``restored_ts``; of several rows of
    one identity the latest deleted_ts decides (of equal ones, one without restored_ts); it is
    deleted if that row has no restored_ts. Both sides meet in one aggregation over their union.
    """
    keys = list(keys)
    cols = [*keys, identity]
    rows = present.select(
        *cols, F.lit(True).alias("present"), F.col("load_ts").alias("first_seen"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_ts"), F.lit(None).cast("boolean").alias("gone"),
    )
    if deletions is not None:
        rows = rows.unionByName(
            deletions.select(
                *cols, F.lit(False).alias("present"), F.lit(None).cast("timestamp_ntz").alias("first_seen"),
                F.col("deleted_ts").cast("timestamp_ntz").alias("deleted_ts"), F.col("restored_ts").isNull().alias("gone"),
            )
        )
    one = rows.groupBy(*cols).agg(
        F.max("present").alias("present"), F.min("first_seen").alias("first_seen"),
        F.max(F.when(~F.col("present"), F.struct("deleted_ts", "gone"))).alias("d"),
    )
    return one.select(*keys, "present", "first_seen", F.coalesce(F.col("d.gone"), F.lit(False)).alias("deleted"))


def unresolved_references(
    refs: DataFrame, states: DataFrame, keys: Sequence[str], arrival: str | None = None, match: str = "simple"
) -> DataFrame:
    """The references that lead to no record, with the column ``reason``.

    refs: the key columns (the same names as in states) and any others, which are passed on, but for a ``reason``, which is
    replaced. states:
    see key_states(). References are grouped by which of their key columns are null; each group is
    joined on its non-null columns only, so rows of one mask never meet those of another:

    - match "simple": a reference with any null refers to nothing and is no case.
    - match "partial": the non-null columns must agree with some record; all null is no case.
    - match "full": all null is no case, some null is the case ``partial_null``.

    reason is the first that holds: ``deleted`` (every agreeing record is deleted), ``missing`` (none
    agrees), ``late`` (the earliest agreeing record arrived after the reference's ``arrival``; null
    arrivals are never late). Repeated references give repeated rows; empty tables give an empty
    result or only ``missing``. A key that a large part of the references name is never shuffled
    (see skew_join).
    """
    if match not in MATCH:
        raise ValueError(match)
    keys, cols = list(keys), [c for c in refs.columns if c != "reason"]
    refs = refs.select(*[F.col(f"`{c}`") for c in cols])
    parts = []
    masks = [m for m in product([True, False], repeat=len(keys)) if any(m)]
    for mask in masks:
        whole = all(mask)
        if not whole and match == "simple":
            continue
        cond = reduce(lambda a, b: a & b, [F.col(k).isNotNull() if m else F.col(k).isNull() for k, m in zip(keys, mask)])
        group = refs.filter(cond)
        if not whole and match == "full":
            parts.append(group.withColumn("reason", F.lit("partial_null")))
            continue
        on = [k for k, m in zip(keys, mask) if m]
        target = states.filter(" and ".join(f"`{k}` is not null" for k in on)).groupBy(*on).agg(
            F.max("present").alias("_present"), F.min("deleted").alias("_deleted"), F.min("first_seen").alias("_seen")
        )
        late = (F.col("_seen") > F.col(arrival)) if arrival else F.lit(False)
        reason = (
            F.when(F.col("_deleted"), "deleted").when(~F.coalesce("_present", F.lit(False)), "missing").when(late, "late")
        )
        parts.append(
            skew_join(group, target, on, "left").withColumn("reason", reason).filter("reason is not null").select(*cols, "reason")
        )
    return reduce(DataFrame.unionByName, parts)
