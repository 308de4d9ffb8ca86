"""Subject areas of documents: averaged word and subword embeddings with logistic outputs (problem 2).

A sentence is the mean of the embeddings of its words and of their character n-grams (hashed), and
each subject has an independent logistic output. Training sentences are those of a bounded sample of
labelled documents, each with all subjects of its document as targets: words that occur under every
subject end with low outputs everywhere, so sentences without a subject are recognised as such. Every
step computes the gradient on all partitions of the sample, sums it and updates the model once. A fifth of
the sample's documents is held out; the step with the lowest loss there gives the model.

Every sentence of every text is then scored, in one pass over the texts: a sentence belongs to every
subject whose output is high enough, and a text has the subjects that hold at least a fifth of its
subject-related sentences.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import canonical_title
from ..session import cut, skew_join

WORD = r"\p{L}{2,}"
#: Markup of wiki articles. Bold titles that open an article are not part of its first sentence.
OPENING = r"(?m)^\s*'''[^'\n]+'''\s*[–-]"
MARKUP = r"(?m)<ref[^>]*>[^<]*</ref>|</?\w+[^>]*>|\{\{[^{}\n]*\}\}|\[\[[^\[\]\n|:]*:[^\[\]\n]*\]\]|'''|^[=|{}].*$|https?://\S+"
LINK = r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n]*)\]\]"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
#: First words of categories that only serve upkeep.
UPKEEP = ["artykuły", "hasła", "wpisy", "strony", "zalążki", "szablony", "articles", "pages", "stubs", "entries"]


@dataclass(frozen=True)
class Settings:
    """labelled: at most so many labelled documents train the model (those with the smallest hash of
    their id), in at most ``shards`` partitions, one for each ``per_shard`` documents. Training ends when, after ``least`` steps, ``patience`` steps
    bring no lower loss on the held-out documents, or after ``steps``."""

    labelled: int = 8000
    buckets: int = 1 << 15
    size: int = 16
    steps: int = 60
    least: int = 12
    patience: int = 4
    rate: float = 0.1
    shards: int = 8
    per_shard: int = 1000
    accept: float = 0.6
    share: float = 0.2


def clean(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, OPENING, " "), MARKUP, " ")
    return F.regexp_replace(t, LINK, "$1")


def sentence_words(df: DataFrame, text: str, outer: bool = False) -> DataFrame:
    """df's other columns and ``words``, one row per sentence of three words or more. A text without any, such as null,
    has no row, or, if outer, one with null words."""
    rest = [c for c in df.columns if c != text]
    # inside one expression, as a filter on an extracted column would extract twice
    found = F.transform(F.split(clean(F.col(text)), SENTENCE_END), lambda x: F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)))
    explode = F.explode_outer if outer else F.explode
    return df.select(*rest, explode(F.filter(found, lambda w: F.size(w) >= 3)).alias("words"))


def title_words(df: DataFrame, title: str) -> DataFrame:
    """df's columns and ``words`` of the titles of categories; those that only serve upkeep are left out."""
    d = df.withColumn("words", F.regexp_extract_all(F.lower(title), F.lit(WORD), F.lit(0)))
    return d.filter((F.size("words") > 0) & ~F.try_element_at("words", F.lit(1)).isin(UPKEEP))


#: An odd number for multiplicative hashing.
MIX = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams of 3 to 5, word after word, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    word, first = np.repeat(np.arange(len(words)), length), _starts(length)
    power = np.cumprod(np.full(int(length.max()), MIX, np.uint64))
    whole = np.add.reduceat(chars * power[np.arange(len(chars)) - first[word]], first)
    owners, hashes = [np.arange(len(words))], [whole]
    for n in (3, 4, 5):
        if len(chars) >= n:
            inside = np.flatnonzero(word[: len(chars) - n + 1] == word[n - 1 :])
            owners.append(word[inside])
            hashes.append(sum(chars[inside + i] * power[i] for i in range(n)) + np.uint64(n))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(31))) * MIX
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return bucket[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], lengths.cumsum()[:-1]]).astype(np.int64)


def _sorted(index: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sums by index: the owners in the order of the index, where each value of the index begins, and the values."""
    order = np.argsort(index, kind="stable")
    k = index[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return owner[order], first, k[first]


def _spread(rows: np.ndarray, by: tuple[np.ndarray, ...], size: int) -> np.ndarray:
    """The sum of the rows of each index's owners."""
    owner, first, values = by
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[values] = np.add.reduceat(rows[owner], first, axis=0)
    return out


class Block:
    """The sentences of a partition as arrays: words by sentence, features by word."""

    INTS = ("word", "count", "feature", "per_word", "w_owner", "w_first", "w_value", "f_owner", "f_first", "f_value")
    FLOATS = ("targets", "learn")

    def __init__(self, words: list[list[str]], targets: np.ndarray, learn: np.ndarray, buckets: int):
        number: dict[str, int] = {}
        self.word = np.array([number.setdefault(w, len(number)) for s in words for w in s], np.int64)
        self.count = np.array([len(s) for s in words], np.int64)
        self.feature, self.per_word = features(list(number), buckets)
        self.w_owner, self.w_first, self.w_value = _sorted(self.word, np.repeat(np.arange(len(self.count)), self.count))
        self.f_owner, self.f_first, self.f_value = _sorted(self.feature, np.repeat(np.arange(len(self.per_word)), self.per_word))
        self.targets = targets.astype(np.float32)
        self.learn = learn.astype(np.float32)

    def pack(self) -> dict[str, bytes]:
        return {k: (v.astype(np.int32) if k in self.INTS else v).tobytes() for k, v in vars(self).items()}

    @classmethod
    def unpack(cls, row: dict[str, bytes], subjects: int) -> Block:
        b = cls.__new__(cls)
        for k in cls.INTS:
            setattr(b, k, np.frombuffer(row[k], np.int32))
        b.targets = np.frombuffer(row["targets"], np.float32).reshape(-1, subjects)
        b.learn = np.frombuffer(row["learn"], np.float32)
        return b

    def gradient(self, e: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums over the sentences to learn from of the gradients of the log loss, and the loss of these and of the held-out ones."""
        vectors = np.add.reduceat(e[self.feature], _starts(self.per_word), axis=0)
        n = np.add.reduceat(self.per_word[self.word], _starts(self.count), dtype=np.int64).astype(np.float32)[:, None]
        h = np.add.reduceat(vectors[self.word], _starts(self.count), axis=0) / n
        p = 1 / (1 + np.exp(-np.clip(h @ w + b, -30, 30)))
        g = (p - self.targets) * self.learn[:, None]
        each = -(self.targets * np.log(p + 1e-9) + (1 - self.targets) * np.log(1 - p + 1e-9)).sum(1)
        loss = np.array([each @ self.learn, each @ (1 - self.learn)], np.float32)
        back = (g @ w.T) / n
        by_word = _spread(back, (self.w_owner, self.w_first, self.w_value), len(self.per_word))
        by_feature = _spread(by_word, (self.f_owner, self.f_first, self.f_value), len(e))
        return by_feature, h.T @ g, g.sum(0), loss


@dataclass
class Model:
    """The trained model as one table of outputs by bucket, from which any word has the sum of its features."""

    outputs: np.ndarray
    bias: np.ndarray
    subjects: list[str]
    losses: list[float]
    held: list[float]


GRADIENT = "e binary, w binary, b binary, loss binary"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for row in b.to_pylist():
            g = [np.frombuffer(x, np.float32) for x in row.values()]
            total = g if total is None else [x + y for x, y in zip(total, g)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], ["e", "w", "b", "loss"])


def train(sentences: DataFrame, subjects: list[str], s: Settings, shards: int) -> Model:
    """sentences: (words, targets array<int> of subject numbers, learn boolean, false for held-out ones), the training sample."""
    spark, k = sentences.sparkSession, len(subjects)
    names = (*Block.INTS, *Block.FLOATS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, targets, learn = [], [], []
        for b in batches:
            for ws, ts, use in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if ws:
                    words.append(ws)
                    targets.append([float(i in ts) for i in range(k)])
                    learn.append(use)
        if words:
            row, n = Block(words, np.array(targets), np.array(learn), s.buckets).pack(), sum(learn)
            cols = [*(pa.array([row[x]], pa.binary()) for x in names), pa.array([n], pa.int64()), pa.array([len(words) - n], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n", "m"])

    fields = ", ".join(f"`{n}` binary" for n in names)
    blocks = cut(sentences.select("words", "targets", "learn").repartition(shards).mapInArrow(pack, f"{fields}, n bigint, m bigint"), "blocks")
    total, held_out = (x or 0 for x in blocks.agg(F.sum("n"), F.sum("m")).first())
    rng = np.random.default_rng(11)
    params = [
        (rng.normal(size=(s.buckets, s.size)) * 0.1).astype(np.float32), (rng.normal(size=(s.size, k)) * 0.3).astype(np.float32), np.full(k, -2, np.float32),
    ]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    losses, held, best = [], [], params
    for step in range(1, s.steps + 2 if total else 1):
        sent = spark.sparkContext.broadcast(params)

        def gradient(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for row in b.to_pylist():
                    g = Block.unpack(row, k).gradient(*sent.value)
                    total = g if total is None else tuple(x + y for x, y in zip(total, g))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in total], ["e", "w", "b", "loss"])

        # one row for each of a bounded number of shards, and one sum of them for the driver
        rows = blocks.mapInArrow(gradient, GRADIENT).repartition(1).mapInArrow(_sum, GRADIENT).collect()
        sent.destroy()
        sums = [np.frombuffer(x, np.float32) for x in rows[0]]
        losses.append(float(sums[3][0]) / total)
        if held_out:
            held.append(float(sums[3][1]) / held_out)
            late = held[s.least - 1 :]  # a few held-out sentences say little about the first steps
            if not late or late[-1] == min(late):
                best = params
            elif len(late) - late.index(min(late)) > s.patience:
                break
        else:
            best = params
        new = []
        for i, p in enumerate(params):  # Adam
            g = sums[i].reshape(p.shape) / np.float32(total)
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.98 * second[i] + 0.02 * g * g
            new.append(p - s.rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.98**step)) + 1e-8))
        params = new
    e, w, b = best
    return Model((e @ w).astype(np.float32), b.astype(np.float32), subjects, losses, held)


#: So many words a worker remembers the outputs of, so as not to sum them again in its next batch or task.
REMEMBERED = 200_000
_known: dict[str, dict[str, tuple[np.ndarray, int]]] = {}


def score(rows: DataFrame, model: Model, accept: float) -> DataFrame:
    """rows: any columns and ``words``. The same columns with ``subject`` in place of words, a row for each subject
    whose output is at least ``accept``, highest first, or one with null; ``lead`` is 1 for the first subject of a
    row of words, else 0. Every word counts, those that the training sample does not have by their n-grams."""
    rest = [f for f in rows.schema.fields if f.name != "words"]
    shared = rows.sparkSession.sparkContext.broadcast((model.outputs, model.bias, model.subjects))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outputs, bias, subjects = shared.value
        if name not in _known:
            _known.clear()
        known = _known.setdefault(name, {})
        names = pa.array(subjects, pa.string())
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(b.num_columns - 1)
            sizes = np.diff(lists.offsets.to_numpy())
            distinct = lists.flatten().dictionary_encode()
            words, at = distinct.dictionary.to_pylist(), distinct.indices.to_numpy()
            if len(known) > REMEMBERED:
                known.clear()
            if new := [x for x in words if x not in known]:
                bucket, per_word = features(new, len(outputs))
                sums = np.add.reduceat(outputs[bucket], _starts(per_word), axis=0)
                known.update(zip(new, zip(sums, per_word.tolist())))
            row = np.repeat(np.arange(b.num_rows), sizes)
            z = np.zeros((b.num_rows, len(subjects)), np.float64)
            n = np.zeros(b.num_rows)
            if len(at):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                by_word = np.array([known[x][0] for x in words], np.float64)
                z[row[first]] = np.add.reduceat(by_word[at], first, axis=0)
                n[row[first]] = np.add.reduceat(np.array([known[x][1] for x in words], np.float64)[at], first)
            z = z / np.maximum(n, 1)[:, None] + bias
            high = (n > 0)[:, None] & (1 / (1 + np.exp(-z)) >= accept)
            who, what = np.nonzero(high)
            none = np.flatnonzero(~high.any(1))
            order = np.lexsort((what, -z[who, what], who))
            who, what = np.concatenate([who[order], none]), np.concatenate([what[order], np.zeros(len(none), np.int64)])
            empty = np.arange(len(who)) >= len(order)
            lead = np.r_[True, who[1:] != who[:-1]] & ~empty
            subject = names.take(pa.array(what, mask=empty))
            picked = [c.take(pa.array(who)) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*picked, subject, pa.array(lead.astype(np.int32))], [*(f.name for f in rest), "subject", "lead"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "subject string, lead int"])
    return rows.select(*[f"`{f.name}`" for f in rest], "words").mapInArrow(run, schema)


def subject_areas(
    texts: DataFrame, labels: DataFrame, subjects: DataFrame, categories: DataFrame, settings: Settings | None = None
) -> tuple[DataFrame, Model]:
    """(doc_id, subject), distinct, and the model.

    texts: (doc_id, page_id, text), whole articles or their lines, with as many rows of one doc_id as
    there are lines; the caller drops repeated lines. labels: (doc_id, subject), null for "none".
    subjects: (subject). categories: (page_id, title) of the links of each page, titles in any spelling.

    A text without subject-related sentences has the subject most of its page's categories have (all
    of those that tie); categories that only serve upkeep have none, and such a text may have no row.
    Null and empty texts count as without sentences. Every word counts in training and scoring, however
    rare it is. Without labels nothing is found.
    """
    s = settings or Settings()
    names = [r[0] for r in subjects.select("subject").filter("subject is not null").distinct().orderBy("subject").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 subjects")
    pages = categories.filter("page_id is not null and title <> ''").select("page_id", "title")
    canonical = lambda d: d.withColumn("title", canonical_title(F.col("title"))).distinct()
    # titles are made canonical only after the links are reduced to the pages in question
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else None
    labelled = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("own"))
    labelled = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.labelled)
    numbers = F.filter(F.transform("own", lambda x: F.try_element_at(number, x)), lambda x: x.isNotNull()) if names else F.array().cast("array<int>")
    targets = cut(labelled.select("doc_id", numbers.alias("targets")), "labels")
    shards = max(1, min(s.shards, -(-targets.count() // s.per_shard)))
    learn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) != 0
    sample = cut(texts.select("doc_id", "page_id", "text").join(F.broadcast(targets), "doc_id").withColumn("learn", learn), "sample")
    titled = sample.select("doc_id", "page_id", "targets", "learn").distinct()  # as many as there are labels, at most
    titled = canonical(pages.join(F.broadcast(titled), "page_id").select("doc_id", "title", "targets", "learn").distinct())
    sample = sentence_words(sample.select("text", "targets", "learn"), "text").select("words", "targets", "learn")
    sample = sample.unionByName(title_words(titled, "title").select("words", "targets", "learn"))
    model = train(sample, names, s, shards)

    found = score(sentence_words(texts.select("doc_id", "page_id", "text"), "text", outer=True), model, s.accept)
    # a row for each text and subject, and with a null subject for each text that has other sentences or none
    per = cut(found.groupBy("doc_id", "page_id", "subject").agg(F.count(F.lit(1)).alias("n"), F.sum("lead").alias("lead")), "subjects")
    by = per.groupBy("doc_id").agg(
        F.sum("lead").alias("all"), F.collect_list(F.when(F.col("subject").isNotNull(), F.struct("subject", "n"))).alias("by"),
        F.collect_set("page_id").alias("pages"),
    )
    by = cut(by, "texts")
    by_text = by.filter("all > 0").select("doc_id", "all", F.explode("by").alias("x")).groupBy("doc_id", "all", "x.subject").agg(F.sum("x.n").alias("n"))
    by_text = by_text.filter(F.col("n") >= F.col("all") * s.share).select("doc_id", "subject")
    # the others by the categories of their pages: each page is scored once, however many texts it has
    others = cut(by.filter("all = 0").select("doc_id", F.explode("pages").alias("page_id")), "others")
    links = skew_join(pages, others.select("page_id").distinct(), ["page_id"], "inner")
    titles = title_words(canonical(links), "title").select("page_id", "words")
    votes = score(titles, model, s.accept).filter("lead = 1").groupBy("page_id", "subject").agg(F.count(F.lit(1)).alias("n"))
    votes = cut(votes.groupBy("page_id").agg(F.collect_list(F.struct("subject", "n")).alias("by")), "votes")
    votes = skew_join(others, votes, ["page_id"], "inner").select("doc_id", F.explode("by").alias("x")).groupBy("doc_id", "x.subject").agg(F.sum("x.n").alias("n"))
    most = votes.groupBy("doc_id").agg(F.collect_list(F.struct("subject", "n")).alias("by"), F.max("n").alias("most"))
    by_page = most.select("doc_id", "most", F.explode("by").alias("x")).filter("x.n = most").select("doc_id", "x.subject")
    return by_text.unionByName(by_page), model
