"""k nearest neighbours, votes and the relative cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sums of floating-point votes are rounded to so many digits before they are compared.
DIGITS = 9


def top_k(sim: DataFrame, k: int, query: str = "query", title: str = "title") -> DataFrame:
    """The k most similar rows of each query with similarity above 0, with ``rank``; ties go to the smaller title."""
    w = W.partitionBy(query).orderBy(F.desc("similarity"), title)
    good = sim.filter("similarity > 0 and not isnan(similarity)")
    return good.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame, query: str = "query") -> DataFrame:
    """(query, category, votes): the similarities of a category's neighbours summed; a category that a neighbour has
    twice counts twice."""
    rows = neighbours.select(query, "similarity", F.explode("categories").alias("category"))
    return rows.groupBy(query, "category").agg(F.round(F.sum("similarity"), DIGITS).alias("votes"))


def relative_cut(p: float) -> Callable[[Column, Column], Column]:
    """Keeps categories with at least the part p of the most votes."""
    return lambda votes, most: F.round(votes / most, DIGITS) >= p


def threshold(votes: DataFrame, p: float = 1.0, keep: Callable[[Column, Column], Column] | None = None, query: str = "query") -> DataFrame:
    """The votes that pass the strategy, by default relative_cut(p), against the most votes of the query."""
    rule = keep or relative_cut(p)
    most = votes.withColumn("_most", F.max("votes").over(W.partitionBy(query)))
    return most.filter(rule(F.col("votes"), F.col("_most"))).drop("_most")


def predict(sim: DataFrame, k: int = 2, p: float = 1.0, query: str = "query") -> DataFrame:
    """(query, category, votes): predicted labels; a query without neighbours has none."""
    return threshold(vote(top_k(sim, k, query), query), p, query=query)
