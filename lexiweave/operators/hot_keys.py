"""Per-key results where a few keys hold most records (problem 5): multi-level tree aggregation.

The input is cut into chunks of a fixed number of rows, where they lie: a chunk never crosses an
input partition, so the first combine runs wholly before any shuffle and moves one state per key and
chunk. The states of hot keys are then merged in rounds of a fixed fan-in, keyed by (key, chunk group),
until one group is left: a key with a third of all rows sends each reducer at most ``fan_in`` states, and
the number of rounds is the logarithm of the number of chunks. Keys with few states don't climb the tree;
they take one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Merge:
    """An aggregate whose states combine by the same rule: sum, min or max of an expression."""

    name: str
    value: Column
    how: str = "sum"

    def first(self) -> Column:
        return getattr(F, self.how)(self.value).alias(self.name)

    def again(self) -> Column:
        return getattr(F, self.how)(F.col(self.name)).alias(self.name)


def tree_aggregate(
    df: DataFrame, keys: Sequence[str], merges: Sequence[Merge], chunk_rows: int = 65536, fan_in: int = 16
) -> DataFrame:
    """One row per key combination with the merged states.

    Null keys form a group of their own. Nulls in values are ignored as in SQL; repeated rows count as
    often as they occur; an empty input gives no rows. Columns other than those named are ignored.
    """
    keys = list(keys)
    if chunk_rows < 1 or fan_in < 2:
        raise ValueError("chunk_rows >= 1 and fan_in >= 2")
    values = {m.name: Merge(m.name, F.col(f"_v{i}"), m.how) for i, m in enumerate(merges)}
    # the id has the partition above bit 33 and the row's place in it below
    d = df.select(*keys, *[m.value.alias(f"_v{i}") for i, m in enumerate(merges)], F.monotonically_increasing_id().alias("_p"))
    d = d.withColumn("_part", F.shiftright("_p", 33))
    d = d.withColumn("_piece", F.floor(F.col("_p").bitwiseAND(F.lit((1 << 33) - 1)) / chunk_rows)).drop("_p")
    level = cut(d.groupBy(*keys, "_part", "_piece").agg(*[m.first() for m in values.values()]), "chunks")
    most = level.agg(F.max("_part"), F.max("_piece")).first()
    if most[0] is None:
        return level.drop("_part", "_piece")
    parts, pieces = most[0] + 1, most[1] + 1
    level = level.withColumn("_chunk", F.col("_piece") * F.lit(parts) + F.col("_part")).drop("_part", "_piece")
    groups = parts * pieces
    states = [m.again() for m in values.values()]
    if groups <= fan_in:
        return level.groupBy(*keys).agg(*states)
    # hot: more than 1 / (4 x shuffle partitions) of all states, so there are at most that many such keys
    bound = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(fan_in, level.count() // bound)).select(*keys)
    hot = df.sparkSession.createDataFrame(few.limit(bound).collect(), few.schema).select(*[F.col(f"`{k}`").alias(f"_h{i}") for i, k in enumerate(keys)])
    flagged = level.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), [F.col(f"`{k}`").eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)], "left")
    tail = flagged.filter("_hot is null").groupBy(*keys).agg(*states)
    level = flagged.filter("_hot")
    while groups > 1:
        groups = -(-groups // fan_in)
        level = level.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in)).groupBy(*keys, "_chunk").agg(*states)
    return tail.unionByName(level.drop("_chunk"))
