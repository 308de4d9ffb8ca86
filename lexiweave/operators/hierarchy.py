"""Parent-child rows of unknown depth to full hierarchies (problem 3).

Nodes are peeled bottom-up. A *rake* step removes every node that is the parent of no remaining node; it
sends its subtree size and height to its parent. Where leaves are few, the remainder is long unary chains
or cycles; a *splice* step then takes nodes with one child out of their chain, an independent set of
about a third of them, and ties the child to the parent by an edge that keeps the length, size and height
of what was taken out. Each step removes a constant part of what remains, so steps number as the
logarithm of the nodes whatever the depth, and all steps together read and write a multiple of the input.
What can't be peeled are the cycles, each spliced to a single node that is its own parent.

The steps reversed assign root, depth and path from the top: a node left before its parent, so the parent
has its values already. A remainder of at most ``local_rows`` nodes, which is one small batch, is peeled
and assigned within one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, new_path, skew_join

ASSIGNED = "id bigint, up bigint, root bigint, depth bigint, path array<bigint>, size bigint, height bigint"


@dataclass
class Hierarchy:
    """nodes: (id, parent, root, depth, path, subtree_size, height); descendants: see hierarchy(); steps: the
    distributed steps, in order."""

    nodes: DataFrame
    descendants: DataFrame | None
    steps: list[str]


def hierarchy(nodes: DataFrame, edges: DataFrame, with_path: bool = True, with_descendants: bool = False, local_rows: int = 1 << 14) -> Hierarchy:
    """Root, depth, path, subtree size and descendants of every node of a forest.

    nodes: column ``id`` (bigint; nulls and repeats are ignored). edges: ``child``, ``parent``;
    other columns are ignored. An edge counts if both ends are nodes; repeated edges count once. If
    a child has several parents, the smallest is its parent. An empty nodes table gives empty results.

    nodes of the result, one row per id: ``parent`` (null for a root), ``root``, ``depth`` (0 for a
    root), ``path`` (ids from the root down to the node; null if with_path is false), ``subtree_size``
    (the node included) and ``height`` (edges down to its deepest leaf, the round in which leaf peeling
    reaches it). On a cycle (a node that is its own parent included) depth is -1, below one -2; root is then
    the smallest id on the cycle and path is null. subtree_size and height of a node on a cycle cover only
    the trees that hang from it.

    descendants of the result: (ancestor, descendant, distance >= 1), for nodes off cycles; a node on
    a cycle has the nodes of its hanging trees. They are rows, never arrays, so a root above a third of all
    nodes is spread over all tasks.
    """
    spark = nodes.sparkSession
    keep = with_path or with_descendants
    ids = cut(nodes.select(F.col("id").cast("bigint").alias("id")).filter("id is not null").distinct(), "ids")
    e = edges.select(F.col("child").cast("bigint").alias("child"), F.col("parent").cast("bigint").alias("parent"))
    e = cut(e.filter("child is not null and parent is not null").distinct(), "pairs")
    e = skew_join(e, ids.withColumnRenamed("id", "parent"), ["parent"], "inner").groupBy("child").agg(F.min("parent").alias("parent"))
    e = cut(e.join(ids.withColumnRenamed("id", "child"), "child", "left_semi"), "edges")
    kids = e.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("deg"), F.bit_xor("child").alias("kid"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    rest = ids.join(e.withColumnRenamed("child", "id"), "id", "left").join(kids, "id", "left").select(
        "id", F.col("parent").alias("up"),
        # the edge to the nearest remaining ancestor: length; nodes, height above the ancestor, smallest id and ids of what was taken out of it
        "parent", F.lit(1).cast("bigint").alias("dist"), zero.alias("extra"), none.alias("reach"), none.alias("low"),
        (F.array() if keep else F.lit(None)).cast("array<bigint>").alias("via"),
        # remaining children: their number, and the bitwise sum of their ids, which for one child is its id
        F.coalesce("deg", zero).alias("deg"), F.coalesce("kid", zero).alias("kid"), F.lit(1).cast("bigint").alias("size"), zero.alias("height"),
    )
    rest = cut(rest, "forest")

    gone: list[tuple[str, DataFrame, Column]] = []
    chained = (F.col("deg") == 1) & F.coalesce(F.col("parent") != F.col("id"), F.lit(False))
    while True:
        n = rest.agg(
            F.count(F.lit(1)).alias("all"), F.count_if(F.col("deg") == 0).alias("leaves"), F.count_if(chained).alias("chained"),
            F.count_if(F.coalesce(F.col("parent") != F.col("id"), F.lit(True))).alias("open"),
        ).first()
        if n["all"] <= local_rows or not n["open"]:
            break
        if 3 * n["leaves"] >= n["chained"]:
            leaf = F.col("deg") == 0
            gone.append(("rake", rest, leaf))
            rest = cut(_rake(rest, leaf), "raked")
        else:
            rank = lambda c: F.xxhash64(c, F.lit(len(gone)))
            taken = chained & (rank(F.col("id")) > rank(F.col("parent"))) & (rank(F.col("id")) > rank(F.col("kid")))
            gone.append(("splice", rest, taken))
            rest = cut(_splice(rest, taken, keep), "spliced")

    out = new_path(spark, "assigned")
    if n["all"] <= local_rows:
        rest.coalesce(1).mapInArrow(_finish, ASSIGNED).write.parquet(f"{out}/part={len(gone)}")
    else:  # cycles alone
        rest.select(
            "id", "up", F.least("id", "low").alias("root"), F.lit(-1).cast("bigint").alias("depth"),
            (F.array("id") if keep else F.lit(None)).cast("array<bigint>").alias("path"), "size", "height",
        ).write.parquet(f"{out}/part={len(gone)}")
    for k in range(len(gone) - 1, -1, -1):
        kind, table, leaves = gone[k]
        above = spark.read.schema(ASSIGNED).parquet(*[f"{out}/part={j}" for j in range(k + 1, len(gone) + 1)])
        (_assign if kind == "rake" else _assign_spliced)(table, leaves, above).select("id", "up", "root", "depth", "path", "size", "height").write.parquet(f"{out}/part={k}")
    done = spark.read.schema(ASSIGNED).parquet(*[f"{out}/part={j}" for j in range(len(gone) + 1)])
    result = done.select(
        "id", F.col("up").alias("parent"), "root", "depth", F.when((F.col("depth") >= 0) & F.lit(with_path), F.col("path")).alias("path"),
        F.col("size").alias("subtree_size"), "height",
    )
    desc = None
    if with_descendants:  # every node to each node above it on its path
        up = done.filter(F.size("path") > 1).select("id", F.size("path").alias("n"), F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor"))
        desc = up.select("ancestor", F.col("id").alias("descendant"), (F.col("n") - 1 - F.col("at")).alias("distance"))
    return Hierarchy(result, desc, [g[0] for g in gone])


def _rake(rest: DataFrame, leaf: Column) -> DataFrame:
    """What remains without the leaves, with their sizes and heights added to their parents."""
    sent = rest.filter(leaf & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor("id").alias("_x"), F.sum(F.col("size") + F.col("extra")).alias("_size"),
        F.max(F.greatest(F.col("height") + F.col("dist"), "reach")).alias("_height"),
    )
    zero = F.lit(0).cast("bigint")
    new = {
        "deg": F.col("deg") - F.coalesce("_n", zero), "kid": F.col("kid").bitwiseXOR(F.coalesce("_x", zero)),
        "size": F.col("size") + F.coalesce("_size", zero), "height": F.greatest("height", "_height"),
    }
    return rest.filter(~leaf).join(sent, "id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in rest.columns])


def _splice(rest: DataFrame, taken: Column, keep: bool) -> DataFrame:
    """What remains without the taken nodes, each one's child tied to its parent. No two taken nodes are neighbours."""
    v = rest.filter(taken)
    to_kid = v.select(F.col("kid").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("id", "parent", "dist", "extra", "reach", "low", "via", "size", "height")])
    to_top = v.groupBy(F.col("parent").alias("id")).agg(F.bit_xor(F.col("id").bitwiseXOR(F.col("kid"))).alias("_x"))
    moved = F.col("_id").isNotNull()
    new = {
        "parent": F.when(moved, F.col("_parent")).otherwise(F.col("parent")),
        "dist": F.when(moved, F.col("dist") + F.col("_dist")).otherwise(F.col("dist")),
        "extra": F.when(moved, F.col("extra") + F.col("_size") + F.col("_extra")).otherwise(F.col("extra")),
        "reach": F.when(moved, F.greatest(F.col("reach") + F.col("_dist"), F.col("_height") + F.col("_dist"), "_reach")).otherwise(F.col("reach")),
        "low": F.when(moved, F.least("low", "_id", "_low")).otherwise(F.col("low")),
        "kid": F.col("kid").bitwiseXOR(F.coalesce("_x", F.lit(0).cast("bigint"))),
    }
    if keep:
        new["via"] = F.when(moved, F.concat("_via", F.array("_id"), "via")).otherwise(F.col("via"))
    left = rest.filter(~taken).join(to_kid, "id", "left").join(to_top, "id", "left")
    return left.select(*[new.get(c, F.col(c)).alias(c) for c in rest.columns])


def _above(above: DataFrame) -> DataFrame:
    return above.select(F.col("id").alias("parent"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))


def _assign(table: DataFrame, leaf: Column, above: DataFrame) -> DataFrame:
    """Raked nodes from their parents."""
    d = skew_join(table.filter(leaf), _above(above), ["parent"], "left")
    depth = F.when(F.col("_depth").isNull(), F.lit(0)).when(F.col("_depth") < 0, F.lit(-2)).otherwise(F.col("_depth") + F.col("dist"))
    path = F.when(F.col("parent").isNull(), F.concat("via", F.array("id"))).otherwise(F.concat("_path", "via", F.array("id")))
    return d.select("id", "up", F.coalesce("_root", "id").alias("root"), depth.cast("bigint").alias("depth"), path.alias("path"), "size", "height")


def _assign_spliced(table: DataFrame, taken: Column, above: DataFrame) -> DataFrame:
    """Spliced nodes: place from the parent, size and height from the child; on a cycle if the child is on it."""
    below = table.select(F.col("id").alias("kid"), F.col("dist").alias("_kdist"), F.col("extra").alias("_kextra"), F.col("reach").alias("_kreach"))
    child = above.select(F.col("id").alias("kid"), F.col("size").alias("_ksize"), F.col("height").alias("_kheight"), F.col("depth").alias("_kdepth"))
    d = cut(table.filter(taken).join(below, "kid").join(child, "kid"), "chains")
    d = skew_join(d, _above(above), ["parent"], "inner")
    cyclic = F.col("_kdepth") == -1
    depth = F.when(cyclic, F.lit(-1)).when(F.col("_depth") < 0, F.lit(-2)).otherwise(F.col("_depth") + F.col("dist"))
    size = F.col("size") + F.when(cyclic, F.lit(0)).otherwise(F.col("_ksize") + F.col("_kextra"))
    height = F.when(cyclic, F.col("height")).otherwise(F.greatest("height", F.col("_kheight") + F.col("_kdist"), "_kreach"))
    path = F.when(F.col("_path").isNull(), F.col("_path")).when(cyclic, F.array("id")).otherwise(F.concat("_path", "via", F.array("id")))
    return d.select("id", "up", F.col("_root").alias("root"), depth.cast("bigint").alias("depth"), path.alias("path"), size.alias("size"), height.alias("height"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All steps of a small remainder, up and down."""
    node = {r["id"]: r for b in batches for r in b.to_pylist()}
    peeled, ready = [], [i for i, r in node.items() if r["deg"] == 0]
    while ready:
        r = node[ready.pop()]
        peeled.append(r)
        if (p := node.get(r["parent"])) is not None:
            p["size"] += r["size"] + r["extra"]
            p["height"] = max(p["height"], r["height"] + r["dist"], r["reach"] or 0)
            p["deg"] -= 1
            if p["deg"] == 0:
                ready.append(p["id"])
    order = []
    for r in node.values():
        if r["deg"] > 0 and "root" not in r:  # the remaining nodes of a cycle
            ring = [r]
            while (x := node[ring[-1]["parent"]]) is not r:
                ring.append(x)
            low = min(min(x["id"], x["id"] if x["low"] is None else x["low"]) for x in ring)
            for x in ring:
                x |= {"root": low, "depth": -1, "path": [x["id"]] if x["via"] is not None else None}
            order += ring
    for r in reversed(peeled):
        p = node.get(r["parent"])
        place = {"root": r["id"], "depth": 0} if p is None else {"root": p["root"], "depth": p["depth"] + r["dist"] if p["depth"] >= 0 else -2}
        r |= place | {"path": [*(p["path"] if p else []), *r["via"], r["id"]] if r["via"] is not None else None}
        order.append(r)
    for at in range(0, len(order), 1024):
        rows = order[at : at + 1024]
        cols = [("id", pa.int64()), ("up", pa.int64()), ("root", pa.int64()), ("depth", pa.int64()), ("path", pa.list_(pa.int64())), ("size", pa.int64()), ("height", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in cols], [c for c, _ in cols])
