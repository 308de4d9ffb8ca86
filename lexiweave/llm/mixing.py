"""Mixing sources to target shares over a curriculum (problem 7).

Each source has a weight schedule over the training run, t from 0 to 1. Its integral up to t, times
the size of the mix, is the source's cumulative token demand. A source's documents, in hashed order
and as often as it may be repeated, fill that demand; the demand inverted at a document's place in
the running token total is the document's training position, and the mix is range-sorted by it.

The running totals are prefix sums over range-partitioned rows: one sum per partition and source goes
to the driver (their number is that of the partitions), no source is gathered in one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


#: Fixed value: how byte-level BPE of this vocabulary cuts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(tokenizer: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts, by a file of byte-level BPE: ranks (``.tiktoken``) or ``.json``."""
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for i in range(0, len(texts), 64) for e in t.encode_batch(texts[i : i + 64], add_special_tokens=False)]


def count_tokens(docs: DataFrame, text: str, tokenizer: str) -> DataFrame:
    """docs with ``n_tokens`` in place of the text: tokens of the whole text. Null and empty texts have 0.

    tokenizer: a file that the driver can read; it is sent to the executors with the job."""
    rest = [f for f in docs.schema.fields if f.name != text]
    name = os.path.basename(tokenizer)
    docs.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(SparkFiles.get(name))
        for b in batches:
            n = count([x or "" for x in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*(f.name for f in rest), "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "n_tokens bigint"])
    return docs.select(*[f"`{f.name}`" for f in rest], text).mapInArrow(run, schema)


@dataclass
class Plan:
    """What a source gives: tokens available, allowed repeats, and tokens wanted of the mix."""

    target: float
    repeats: int
    available: int
    wanted: float = 0.0
    knots: list[tuple[float, float]] = field(default_factory=list)

    @property
    def capacity(self) -> float:
        return float(self.available) * self.repeats


def fill(plans: dict[str, Plan], total: float) -> None:
    """Give each source its share of total; what a source cannot give within its repeats is divided
    among the others in proportion to their targets, until all is given or all are exhausted."""
    open_, left = {k for k, p in plans.items() if p.target > 0 and p.capacity > 0}, total
    for p in plans.values():
        p.wanted = 0.0
    while open_:
        weight = sum(plans[k].target for k in open_)
        full = {k for k in open_ if plans[k].capacity <= left * plans[k].target / weight}
        if not full:
            for k in open_:
                plans[k].wanted = left * plans[k].target / weight
            return
        for k in full:
            plans[k].wanted = plans[k].capacity
            left -= plans[k].capacity
        open_ -= full


def ramp(plans: dict[str, Plan], strength: float) -> None:
    """The default curriculum: sources that may be repeated gain weight linearly over the run, those that may
    not lose as much, so that the weights sum to one at any time and each integrates to its share."""
    total = sum(p.wanted for p in plans.values()) or 1.0
    late = sum(p.wanted for p in plans.values() if p.repeats > 1) / total
    for p in plans.values():
        share = p.wanted / total
        slope = strength * min(late, 1 - late)
        part = share / late if p.repeats > 1 and late else -share / (1 - late) if p.repeats <= 1 and late < 1 else 0.0
        p.knots = [(0.0, share - slope * part), (1.0, share + slope * part)]


def invert(knots: list[tuple[float, float]], demand: np.ndarray) -> np.ndarray:
    """t at which the integral of the piecewise linear weights reaches each demand, a part of 0 to 1 of the whole."""
    t, w = np.array([k[0] for k in knots]), np.maximum(np.array([k[1] for k in knots]), 0.0)
    area = np.concatenate([[0], ((w[1:] + w[:-1]) / 2 * np.diff(t)).cumsum()])
    if area[-1] <= 0:
        return np.asarray(demand, float)
    d = np.clip(demand, 0, 1) * area[-1]
    i = np.clip(np.searchsorted(area, d, side="right") - 1, 0, len(t) - 2)
    rest, width = d - area[i], t[i + 1] - t[i]
    slope = (w[i + 1] - w[i]) / width
    root = np.sqrt(np.maximum(w[i] ** 2 + 2 * slope * rest, 0))
    # the stable form of the quadratic's root, also right for slope 0
    step = np.where(w[i] + root > 0, 2 * rest / np.where(w[i] + root > 0, w[i] + root, 1), 0)
    return np.minimum(t[i] + np.minimum(step, width), 1.0)


def _running(rows: DataFrame, spark: SparkSession) -> tuple[DataFrame, dict[tuple[int, str], int]]:
    """rows (source, key, doc, n) in the order of (source, key, doc), with the running total of n within
    partition and source, and what precedes each (partition, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(3).to_numpy()
            code = b.column(0).dictionary_encode()
            ids = code.indices.to_numpy()
            run_total = n.cumsum()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            names = [code.dictionary[int(ids[s])].as_py() for s in starts]
            base = np.where(starts > 0, run_total[starts - 1], 0)
            base[0] = -total if names[0] == last else 0
            run_total = run_total - np.repeat(base, np.diff(np.r_[starts, len(n)]))
            last, total = names[-1], int(run_total[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run_total)], ["source", "key", "doc", "n", "upto"])

    ordered = rows.repartitionByRange("source", "key", "doc").sortWithinPartitions("source", "key", "doc")
    schema = rows.select("source", "key", "doc", "n").schema.add("upto", "long")
    summed = cut(ordered.select("source", "key", "doc", "n").mapInArrow(run, schema).withColumn("part", F.spark_partition_id()), "running")
    parts = summed.groupBy("part", "source").agg(F.max("upto").alias("n")).orderBy("source", "part").collect()
    before, sums = {}, {}
    for r in parts:
        before[(r["part"], r["source"])] = sums.get(r["source"], 0)
        sums[r["source"]] = sums.get(r["source"], 0) + r["n"]
    return summed, before


@dataclass
class Mix:
    """rows: (doc_id, source, repeat, n_tokens, position), range-sorted by position; report: one row per source."""

    rows: DataFrame
    report: DataFrame


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, strength: float = 0.5,
    schedules: dict[str, list[tuple[float, float]]] | None = None, seed: int = 5,
) -> Mix:
    """Combine documents so that each source has its target share of the tokens.

    docs: (doc_id bigint, source, n_tokens), one row per document; repeated rows are documents of their
    own. Sources are compared without case and outer blanks; null sources and those without target are
    in the report with target 0 and not in the mix. targets: (source, target_share, max_repeats); if a
    source has several rows, the last in order of share and repeats counts; null or non-positive shares
    or repeats are 0. Shares are scaled to sum to one.

    total_tokens is the size of the mix, by default all tokens of docs. A source gives no document more
    often than max_repeats; if that is not enough, it gives all it may, and the others fill up. A
    document is in the mix while the running total before it is below what its source is to give, so
    a source may exceed that by less than its last document. Texts without tokens take no place in the
    demand and follow the document before them. schedules: (t, weight) knots for a source in place of
    the default ramp of the given strength; only the form counts, the share stays the target's.

    report: source, target_share, actual_share, n_documents and n_tokens available, mix_tokens and
    max_repeat (the most often that any of its documents occurs). Empty docs give an empty mix.
    """
    spark = docs.sparkSession
    clean = lambda c: F.lower(F.trim(c))
    wanted = targets.select(clean(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
    wanted = wanted.filter("source is not null").groupBy("source").agg(F.max(F.struct("share", "repeats")).alias("x"))
    rows = wanted.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many sources with a target")
    d = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc"), clean(F.col("source")).alias("source"), F.col("n_tokens").alias("n")), "tokens")
    have = d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    known = {r["source"]: (r["docs"], r["n"]) for r in have.join(F.broadcast(wanted.select("source")), "source", "left_semi").collect()}
    plans = {r["source"]: Plan(max(r["x"]["share"] or 0.0, 0.0), max(r["x"]["repeats"] or 0, 0), known.get(r["source"], (0, 0))[1]) for r in rows}
    total = total_tokens if total_tokens is not None else (have.agg(F.sum("n")).first()[0] or 0)
    shares = sum(p.target for p in plans.values()) or 1.0
    for p in plans.values():
        p.target /= shares
    fill(plans, float(total))
    ramp(plans, strength)
    for name, knots in (schedules or {}).items():
        if name in plans:
            plans[name].knots = knots
    info = spark.createDataFrame(
        [(k, float(p.wanted), p.available, p.repeats) for k, p in plans.items() if p.wanted > 0 and p.available > 0],
        "source string, wanted double, available bigint, repeats int",
    )
    # the order within a source is one for all repeats, so a document's repeats are one pass apart
    chosen = d.join(F.broadcast(info.select("source")), "source", "left_semi").withColumn("key", F.xxhash64("doc", F.lit(seed)))
    summed, before = _running(chosen.select("source", "key", "doc", "n"), spark)
    offsets = spark.createDataFrame([(p, s, n) for (p, s), n in before.items()], "part int, source string, base bigint")
    placed = summed.join(F.broadcast(offsets), ["part", "source"]).join(F.broadcast(info), "source")
    start: Column = F.col("upto") - F.col("n") + F.col("base")
    # as often as its place in each further pass over the source is still below what the source is to give
    times = F.least(F.col("repeats"), F.ceil((F.col("wanted") - F.col("start")) / F.col("available")).cast("int"))
    placed = placed.withColumn("start", start).filter("start < wanted").withColumn("repeat", F.explode(F.sequence(F.lit(1), times)))
    placed = placed.withColumn("at", F.col("start") + (F.col("repeat") - 1) * F.col("available")).filter("at < wanted")  # against rounding
    curves = {k: p.knots for k, p in plans.items()}

    def position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, source = b.column(4).to_numpy() / b.column(5).to_numpy(), np.array(b.column(1).to_pylist(), object)
            t = np.zeros(len(at))
            for s in set(source):
                t[source == s] = invert(curves[s], at[source == s])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(t)], ["doc_id", "source", "repeat", "n_tokens", "position"])

    out = placed.select(F.col("doc").alias("doc_id"), "source", "repeat", F.col("n").alias("n_tokens"), F.col("at").cast("double").alias("at"), "wanted")
    out = out.mapInArrow(position, "doc_id bigint, source string, repeat int, n_tokens bigint, position double")
    out = cut(out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "repeat"), "mix")
    got = out.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.max("repeat").alias("max_repeat"))
    whole = out.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("whole"))
    aims = spark.createDataFrame([(k, float(p.target)) for k, p in plans.items()], "source string, target_share double")
    report = (
        have.withColumn("k", F.coalesce("source", F.lit(""))).join(aims.withColumnRenamed("source", "k"), "k", "full").drop("source")
        .join(got.withColumnRenamed("source", "k"), "k", "left").join(F.broadcast(whole))
        .select(
            F.col("k").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce(F.try_divide(F.col("mix_tokens"), F.col("whole")), F.lit(0.0)).alias("actual_share"),
            F.coalesce("docs", F.lit(0)).alias("n_documents"), F.coalesce("n", F.lit(0)).alias("n_tokens"),
            F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("max_repeat", F.lit(0)).alias("max_repeat"),
        )
    )
    return Mix(out, report)
