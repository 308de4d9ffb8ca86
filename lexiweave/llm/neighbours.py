"""Most similar vectors for every vector: cross-polytope hashing (problem 1).

Unit vectors are turned by fast Hadamard pseudo-rotations (random signs, Walsh-Hadamard transform,
three times) and assigned to the nearest signed axis. Independent tables are built; a vector is entered
into its best cells of each table (multiprobe), so two vectors meet if any of their probed cells agree.
Every cell is one task-sized group: a block product gives each member its k best mates, and only those
travel on.

How many tables, probes and cells there are is fitted to the data: the exact neighbours of a bounded
sample of vectors among all vectors are found, and of all settings in which enough of these pairs meet the
cheapest is taken. So the recall stays where it was asked to be as the data grow; what grows is the number
of tables and probes. A cell that grows too large is compared in blocks, all pairs of them, and vectors
that met fewer than k others are compared with all, so nothing is left out by size.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if, cut, skew_join


def _rotations(n: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (n, 3, dim))


def _turn(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of sign flips and fast Walsh-Hadamard transform of the rows of x."""
    dim = x.shape[1]
    for s in signs:
        x = x * s
        h = 1
        while h < dim:
            y = x.reshape(len(x), dim // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), dim)
            h *= 2
        x = x / np.float32(np.sqrt(dim))
    return x


#: Up to this dimension one dense product by the pseudo-rotation's matrix is quicker in numpy than its steps.
DENSE = 256


def _turner(signs: np.ndarray):
    """The pseudo-rotation as a function of rows and the number of axes wanted."""
    if signs.shape[-1] > DENSE:
        return lambda x, w: _turn(x, signs)[:, :w]
    matrix = _turn(np.eye(signs.shape[-1], dtype=np.float32), signs)
    return lambda x, w: x @ matrix[:, :w]


def _axes(y: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ranks`` nearest signed axes of each row and how much farther than the nearest each is."""
    w = y.shape[1]
    ranks = min(ranks, 2 * w)
    size, rows = np.abs(y), np.arange(len(y))
    if ranks > w:  # so few axes that the opposite ones count too
        both = np.concatenate([y, -y], 1)
        best = np.argsort(-both, 1, kind="stable")[:, :ranks]
        v = np.take_along_axis(both, best, 1)
        return best, (v[:, :1] - v) ** 2
    best, v = np.empty((len(y), ranks), np.int64), np.empty((len(y), ranks), np.float32)
    for r in range(ranks):
        axis = size.argmax(1)
        v[:, r] = size[rows, axis]
        best[:, r] = axis + w * (y[rows, axis] < 0)
        size[rows, axis] = -1
    return best, (v[:, :1] - v) ** 2


def _probes(x: np.ndarray, turns: list, widths: list[int], probes: int) -> np.ndarray:
    """The codes of the ``probes`` best cells of each row: at first the nearest axes, then those in
    which one hash takes one of its next three axes, by the loss that this means."""
    parts = [_axes(turn(x, w), min(probes, 4)) for turn, w in zip(turns, widths)]
    place = [int(np.prod([2 * w for w in widths[i + 1 :]], dtype=np.int64)) for i in range(len(widths))]
    base = sum(a[:, 0].astype(np.int64) * p for (a, _), p in zip(parts, place))
    codes, loss = [base], [np.zeros(len(x), np.float32)]
    for (a, c), p in zip(parts, place):
        for r in range(1, a.shape[1]):
            codes.append(base + (a[:, r].astype(np.int64) - a[:, 0]) * p)
            loss.append(c[:, r])
    order = np.argsort(np.stack(loss, 1), 1, kind="stable")[:, :probes]
    return np.take_along_axis(np.stack(codes, 1), order, 1)


@dataclass(frozen=True)
class Index:
    """``recall``: the part of the sample's neighbours that meet their vectors under these settings."""

    dim: int
    tables: int
    probes: int
    bits: int
    recall: float
    seed: int = 7

    @property
    def widths(self) -> list[int]:
        """The numbers of axes of a table's hashes; each axis has two signs."""
        full = (2 * self.dim).bit_length() - 1
        rest = self.bits % full
        return [self.dim] * (self.bits // full) + ([1 << (rest - 1)] if rest else [])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x probes."""
        signs = _rotations(self.tables * len(self.widths), self.dim, self.seed).reshape(self.tables, len(self.widths), 3, self.dim)
        return np.stack([_probes(x, [_turner(s) for s in table], self.widths, self.probes) for table in signs], 1)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows' bytes."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id bigint, unit binary): the usable vectors as float32 unit vectors, one per id.

    A vector is usable if it has ``dim`` finite numbers that are not all zero and its id is not null.
    If an id has several usable vectors, the one with the smallest bytes stands.
    """
    v = F.col(vec_col)
    ok = df.filter(F.col(id_col).isNotNull() & (F.size(v) == dim))
    ok = ok.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
                x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), _binary(x)], ["id", "unit"])

    units = ok.select(F.col(id_col).cast("bigint"), v.cast("array<double>")).mapInArrow(run, "id bigint, unit binary")
    return units.groupBy("id").agg(F.min("unit").alias("unit"))


def exact_neighbours(units: DataFrame, queries: DataFrame, k: int = 5, dim: int = 64, block_rows: int = 2048, apart: bool = False) -> DataFrame:
    """(id, neighbour, cosine): the k most similar other vectors of each query, by comparison with all.

    units and queries: (id, unit). The queries are read in blocks of block_rows and units are scanned once for
    each, so it is meant for a query set that is small beside units. Every task keeps k candidates a query. Ties
    go to the smaller id. apart: vectors equal to the query don't count. No queries or no units give no rows.
    """
    top = 2 if apart else k + 3

    def scan(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((len(ids), k + top), -9, np.float32)
            near, kept = np.full(best.shape, -1, np.int64), np.zeros((*best.shape, dim), np.float32)
            for b in batches:
                x, other = _matrix(b.column(1), dim), b.column(0).to_numpy()
                for at in range(0, len(x), 2048):
                    y, o = x[at : at + 2048], other[at : at + 2048]
                    s = q @ y.T
                    s[ids[:, None] == o[None, :]] = -9
                    if apart:
                        s[s > 1 - 1e-6] = -9
                    up = np.flatnonzero(s.max(1) >= best[:, -1])  # after some batches, few queries find better ones
                    if not len(up):
                        continue
                    s, m = s[up], min(best.shape[1], len(y))
                    new = np.argpartition(-s, m - 1, 1)[:, :m]
                    both, them = np.concatenate([best[up], np.take_along_axis(s, new, 1)], 1), np.concatenate([near[up], o[new]], 1)
                    order = np.lexsort((them, -both), 1)[:, : best.shape[1]]
                    near[up] = np.take_along_axis(them, order, 1)
                    kept[up] = np.take_along_axis(np.concatenate([kept[up], y[new]], 1), order[:, :, None], 1)
                    best[up] = np.take_along_axis(both, order, 1)
            found = best > -9
            exact = np.einsum("ijd,id->ij", kept.astype(np.float64), q.astype(np.float64))
            who = np.broadcast_to(ids[:, None], best.shape)
            yield pa.RecordBatch.from_arrays([pa.array(who[found]), pa.array(near[found]), pa.array(exact[found])], ["id", "neighbour", "cosine"])

        return units.select("id", "unit").mapInArrow(run, "id bigint, neighbour bigint, cosine double")

    out, ids, vectors = [], [], []
    for row in queries.select("id", "unit").toLocalIterator():
        ids.append(row[0])
        vectors.append(bytes(row[1]))
        if len(ids) == block_rows:
            out.append(scan(np.array(ids), np.frombuffer(b"".join(vectors), np.float32).reshape(-1, dim)))
            ids, vectors = [], []
    if ids or not out:
        out.append(scan(np.array(ids, np.int64), np.frombuffer(b"".join(vectors), np.float32).reshape(-1, dim)))
    found = out[0]
    for d in out[1:]:
        found = found.unionByName(d)
    w = W.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def recall_of(found: DataFrame, exact: DataFrame, k: int = 5) -> DataFrame:
    """One row: queries, neighbours (that exist, at most k a query), found, recall. found: (id, neighbour, cosine); exact: the
    same for the queries, by exact_neighbours(). A neighbour as similar as the last exact one is as good."""
    least = exact.groupBy("id").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n"))
    good = found.join(least, "id").filter(F.col("cosine") >= F.col("least") - 1e-6).groupBy("id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("hits"))
    d = least.join(good, "id", "left").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("neighbours"), F.sum(F.coalesce("hits", F.lit(0))).alias("found"))
    return d.withColumn("recall", F.try_divide("found", "neighbours"))


#: Settings that are tried: tables, probes and rows a cell, and what a setting costs, counted in products of two vectors: a vector
#: sent to a cell as 1,800 (measured), a cell 10,000.
TABLES, PROBES, CELLS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16), (1, 2, 3, 4, 6), (32, 64, 128, 256, 512, 1024)


def fit_index(units: DataFrame, k: int = 5, dim: int = 64, target: float = 0.99, sample: int = 256, seed: int = 7) -> Index:
    """The cheapest settings under which at least ``target`` of the sample's neighbours meet their vectors.

    The sample, the vectors with the smallest hash of their id, is compared with all vectors (equal ones left out, as
    they always meet). If no setting reaches the target, the one with most pairs is taken, with a warning.
    """
    n = units.count()
    chosen = cut(units.orderBy(F.xxhash64("id"), "id").limit(sample), "sample")
    pairs = cut(exact_neighbours(units, chosen, k, dim, apart=True), "pairs")
    wanted = pairs.select(F.col("neighbour").alias("id")).distinct()  # at most sample * k
    near = units.join(F.broadcast(wanted), "id", "left_semi").unionByName(chosen).collect()
    at = {r["id"]: i for i, r in enumerate(near)}
    x = np.frombuffer(b"".join(bytes(r["unit"]) for r in near), np.float32).reshape(-1, dim)
    links = np.array([(at[r["id"]], at[r["neighbour"]]) for r in pairs.collect()], np.int64).reshape(-1, 2)
    options = []
    for cell in CELLS:
        bits = max(1, int(n / cell).bit_length() - 1)
        code = Index(dim, TABLES[-1], PROBES[-1], bits, 0, seed).codes(x) if len(links) else np.zeros((0, TABLES[-1], 1))
        for p in PROBES:
            if p > code.shape[2]:
                continue
            met = (code[links[:, 0]][:, :, :p, None] == code[links[:, 1]][:, :, None, :p]).any((2, 3)) if len(links) else np.ones((1, TABLES[-1]), bool)
            for t in TABLES:
                cost = t * p * (1800 + p * n / 2**bits) + t * 10_000 * 2**bits / max(n, 1)
                options.append((cost, Index(dim, t, p, bits, float(met[:, :t].any(1).mean()), seed)))
    good = [o for o in options if o[1].recall >= target]
    if not good:
        index = max(options, key=lambda o: (o[1].recall, -o[0]))[1]
        warnings.warn(f"no setting reaches a recall of {target}; {index.recall:.3f} is the best", stacklevel=2)
        return index
    return min(good, key=lambda o: o[0])[1]


def nearest_vectors(units: DataFrame, k: int = 5, dim: int = 64, index: Index | None = None, target: float = 0.99, max_cell: int = 4096) -> DataFrame:
    """(id, neighbour, cosine): for every vector its k most similar other vectors.

    units: (id, unit) as made by unit_vectors(); dim must be a power of two. Ties in cosine are
    broken by the smaller id. Equal vectors (whatever their length was) are searched once and then
    share the result: each has the others first, at cosine 1. A vector has fewer than k neighbours only if there are
    no more; an empty table gives no rows. index: the settings, by default fit_index() with the target.
    A cell of more than max_cell rows is compared whole, in pairs of blocks of about max_cell rows.
    """
    if dim & (dim - 1):
        raise ValueError("dim must be a power of two")
    units = cut(units, "units")
    index = index or fit_index(units, k, dim, target)
    fields = "id bigint, n bigint, unit binary, codes array<bigint>"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = index.codes(_matrix(b.column(2), dim)).reshape(b.num_rows, -1)
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * c.shape[1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(c.ravel()))], ["id", "n", "unit", "codes"])

    classes = units.groupBy("unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n", "unit")
    classes = cut(classes.mapInArrow(code, fields), "classes")
    found = cut(_search(classes, k, index, max_cell), "found")
    short = classes.select("id", "unit").join(found.groupBy("id").count().filter(F.col("count") >= k), "id", "left_anti")
    short = cut(short, "short")
    n_short, n = short.count(), classes.count()
    if n_short and n > 1:  # those that met too few others, and all of k vectors or fewer
        found = found.join(short.select("id"), "id", "left_anti").unionByName(exact_neighbours(classes, short, min(k, n - 1), dim))
    many = classes.filter("n > 1").select("unit", F.col("id").alias("rep"))
    if many.isEmpty():
        return found
    # members of classes of equal vectors; a hot class is neither shuffled nor gathered
    member = cut(skew_join(units, many, ["unit"], "inner").select("rep", "id"), "members")
    first = member.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1)
    first = cut(first.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("members")), "first")
    # candidates of a class: its own first members, and the first members of each neighbouring class
    near = skew_join(found, first.withColumnRenamed("rep", "neighbour"), ["neighbour"], "left").select(
        F.col("id").alias("rep"), F.explode(F.coalesce("members", F.array("neighbour"))).alias("neighbour"), "cosine"
    )
    own = first.select("rep", F.explode("members").alias("neighbour"), F.lit(1.0).alias("cosine"))
    w = W.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour")
    best = near.unionByName(own).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    listed = cut(best.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("r", "neighbour", "cosine"))).alias("c")), "listed")
    singles = classes.filter("n = 1").select(F.col("id").alias("rep"), "id")
    everyone = skew_join(member.unionByName(singles), listed, ["rep"], "inner")
    others = F.slice(F.filter("c", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return everyone.select("id", F.explode(others).alias("x")).select("id", "x.neighbour", "x.cosine")


def _search(classes: DataFrame, k: int, index: Index, max_cell: int) -> DataFrame:
    """classes: (id, unit, codes)."""
    dim, key = index.dim, ["t", "cell"]

    def entered(*cols: str) -> DataFrame:
        """A row per vector, table and probe."""
        per_table = F.size("codes") / index.tables
        d = classes.select(*cols, per_table.alias("p"), F.posexplode("codes").alias("at", "cell"))
        return d.withColumn("t", F.floor(F.col("at") / F.col("p")).cast("int")).drop("at", "p")

    heavy = cut(entered().groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_cell), "cells")
    rows = entered("id", "unit")
    if heavy.isEmpty():
        rows = rows.withColumn("a", F.lit(0)).withColumn("b", F.lit(0)).withColumn("mine", F.lit(0))
    else:  # large cells: all pairs of blocks of about max_cell rows
        parts = heavy.select(*key, F.ceil(F.col("n") / max_cell).cast("int").alias("g"))
        rows = rows.join(broadcast_if(parts, 100_000), key, "left").withColumn("g", F.coalesce("g", F.lit(1)))
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        rows = rows.withColumn("a", F.least("mine", "o")).withColumn("b", F.greatest("mine", "o")).drop("o", "g")

    def cell(group: pa.Table) -> pa.Table:
        x, ids = _matrix(group.column("unit"), dim), group.column("id").to_numpy()
        mine, a = group.column("mine").to_numpy(), group.column("a")[0].as_py()
        split = group.column("b")[0].as_py() != a
        rows, best, cos = [], [], []
        for start in range(0, len(x) if len(x) > 1 else 0, 1024):
            block = slice(start, start + 1024)
            s = x[block] @ x.T
            s[np.arange(len(s)), np.arange(start, start + len(s))] = -9
            if split:
                s[mine[block][:, None] == mine[None, :]] = -9
            m = min(k + 3, s.shape[1])
            top = np.argpartition(-s, m - 1, 1)[:, :m]
            exact = np.einsum("ijd,id->ij", x[top].astype(np.float64), x[block].astype(np.float64))
            exact[np.take_along_axis(s, top, 1) == -9] = -9
            order = np.lexsort((ids[top], -exact), 1)[:, :k]
            rows.append(ids[block])
            best.append(np.take_along_axis(ids[top], order, 1))
            cos.append(np.take_along_axis(exact, order, 1))
        if not rows:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64())), "cos": pa.array([], pa.list_(pa.float64()))})
        best, cos = np.concatenate(best), np.concatenate(cos)
        keep = cos > -9
        ends = np.concatenate([[0], keep.sum(1).cumsum()]).astype(np.int32)
        return pa.table({
            "id": np.concatenate(rows),
            "near": pa.ListArray.from_arrays(ends, best[keep]), "cos": pa.ListArray.from_arrays(ends, cos[keep]),
        })

    pairs = rows.select("id", "unit", *key, "a", "b", "mine").groupBy(*key, "a", "b").applyInArrow(cell, "id bigint, near array<bigint>, cos array<double>")
    # at most tables * probes short lists for each id
    merged = pairs.groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip(F.transform("cos", lambda c: -c).alias("far"), F.col("near").alias("near")))).alias("c"))
    top = F.slice(F.array_sort(F.array_distinct("c")), 1, k)
    return merged.select("id", F.explode(top).alias("x")).select("id", F.col("x.near").alias("neighbour"), (-F.col("x.far")).alias("cosine"))
