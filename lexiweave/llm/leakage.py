"""Evaluation passages inside a corpus: Wu-Manber multi-pattern search (problem 6).

Patterns are all runs of ``words`` consecutive words of the test items. A table over hashed text
blocks gives for each block how far the search may jump without passing the start of a pattern, so
most of a text is never looked at; where the jump is zero, the hash of the window's last and first
block selects a bucket of patterns, and only those are compared byte by byte.

The scan runs over the text buffer of an Arrow batch, all texts of the batch (long texts in
segments) stepping together in numpy. It is one pass without a shuffle; only hits leave it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK = 8
TABLE_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = 4096


def _folds() -> tuple[str, str]:
    """Lower-case letters with diacritical marks and what they are without, by Unicode decomposition."""
    pairs = {"ł": "l"}
    for c in map(chr, range(0xC0, 0x2000)):
        d = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(d) > 1 and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:]):
            pairs[c] = d[0]
    return "".join(pairs), "".join(pairs.values())


def plain_words(text: Column) -> Column:
    """`` word word ``: the words of a text (maximal runs of letters and digits) in lower case and
    without diacritical marks, each between single blanks. Null for null, one blank for no words."""
    src, dst = _folds()
    t = F.regexp_replace(F.translate(F.lower(text), src, dst), r"\p{M}+", "")
    return F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def runs(words: str, n: int) -> list[str]:
    """All runs of n consecutive words of a text in the form of plain_words()."""
    w = words.split()
    return [f" {' '.join(w[i : i + n])} " for i in range(len(w) - n + 1)]


class WuManber:
    """Multi-pattern search over bytes. patterns: each with its list of ids; all at least 16 bytes."""

    def __init__(self, patterns: dict[bytes, list[int]]):
        self.patterns = list(patterns)
        self.ids = list(patterns.values())
        self.m = m = min(map(len, self.patterns))
        if m < 2 * BLOCK:
            raise ValueError("patterns are too short")
        heads = np.frombuffer(b"".join(p[:m] for p in self.patterns), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << TABLE_BITS, m - BLOCK + 1, np.uint16)
        for end in range(BLOCK, m + 1):
            h = self._hash(np.ascontiguousarray(heads[:, end - BLOCK : end]).view("<u8")[:, 0])
            self.shift[h] = np.minimum(self.shift[h], m - end)
        last = np.ascontiguousarray(heads[:, m - BLOCK :]).view("<u8")[:, 0]
        first = np.ascontiguousarray(heads[:, :BLOCK]).view("<u8")[:, 0]
        key = self._key(first, last)
        self.order = np.argsort(key, kind="stable")
        self.keys, self.starts, self.counts = np.unique(key[self.order], return_index=True, return_counts=True)

    @staticmethod
    def _hash(block: np.ndarray) -> np.ndarray:
        return (block * MIX) >> np.uint64(64 - TABLE_BITS)

    @staticmethod
    def _key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (first * MIX) ^ (last + (first >> np.uint64(7)))

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text number, pattern number) of every occurrence in data[starts[i]:ends[i]]."""
        m = self.m
        fits = np.flatnonzero(ends - starts >= m)
        if not len(fits):
            return
        # lanes: ends of windows, in segments of SEGMENT positions
        n = -(-(ends[fits] - starts[fits] - m + 1) // SEGMENT)
        text = np.repeat(fits, n)
        k = np.arange(len(text)) - np.repeat(n.cumsum() - n, n)
        pos = starts[text] + m + k * SEGMENT
        stop = np.minimum(pos + SEGMENT, ends[text] + 1)
        blocks = np.ndarray(buffer=data, dtype="<u8", shape=(len(data) - BLOCK + 1,), strides=(1,))
        while len(pos):
            last = blocks[pos - BLOCK]
            s = self.shift[self._hash(last)]
            hit = np.flatnonzero(s == 0)
            if len(hit):
                key = self._key(blocks[pos[hit] - m], last[hit])
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                for j in np.flatnonzero(self.keys[at] == key):
                    t, begin = int(text[hit[j]]), int(pos[hit[j]]) - m
                    for p in self.order[self.starts[at[j]] : self.starts[at[j]] + self.counts[at[j]]]:
                        pattern = self.patterns[p]
                        if begin + len(pattern) <= ends[t] and data[begin : begin + len(pattern)].tobytes() == pattern:
                            yield t, int(p)
            pos = pos + np.maximum(s, 1)
            on = pos < stop
            if not on.all():
                pos, stop, text = pos[on], stop[on], text[on]


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passages: list[str],
    words: int = 12, block_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, item_id), distinct: the text holds at least ``words`` consecutive words of one of the
    item's passages, compared as plain_words() writes them.

    Null and empty texts, passages that are null or have fewer words, and empty tables give no case;
    repeated rows give one case; items that share a passage are all reported; other columns are
    ignored. Whole texts are searched. The test items are the query set: they are read in blocks of
    about block_bytes of text, and the corpus is scanned once for each block (its words are written once if there are several), so the size of what is
    sent to the tasks is bounded whatever the number of items.
    """
    id_type = docs.schema[doc_id].dataType
    corpus = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id), plain_words(F.col(text)).cast("binary").alias("_words"))
    stored = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), *[plain_words(F.col(p)).alias(f"p{k}") for k, p in enumerate(passages)])
    out, patterns, used = [], {}, 0

    def scan(corpus: DataFrame, patterns: dict[bytes, set[int]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast([(p, sorted(i)) for p, i in patterns.items()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = WuManber(dict(shared.value))
            for b in batches:
                if not b.num_rows or b.column(1).buffers()[2] is None:
                    continue
                ends = np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset :][: b.num_rows + 1].astype(np.int64)
                data = np.frombuffer(b.column(1).buffers()[2], np.uint8)
                if len(data) < BLOCK:
                    continue
                found = sorted({(t, i) for t, p in machine.search(data, ends[:-1], ends[1:]) for i in machine.ids[p]})
                if found:
                    t, i = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(i, pa.int64())], [doc_id, item_id])

        return corpus.mapInArrow(run, f"`{doc_id}` {id_type.simpleString()}, `{item_id}` bigint")

    for row in stored.toLocalIterator():
        for p in row[1:]:
            for r in runs(p or "", words):
                patterns.setdefault(r.encode(), set()).add(row[0])
                used += len(r)
        if used > block_bytes * words:
            if not out:  # there will be further scans: the words are written once
                corpus = cut(corpus, "words")
            out, patterns, used = [*out, scan(corpus, patterns)], {}, 0
    if patterns or not out:
        out.append(scan(corpus, patterns) if patterns else docs.select(doc_id, F.lit(0).cast("bigint").alias(item_id)).limit(0))
    result = out[0]
    for d in out[1:]:
        result = result.unionByName(d)
    return result.distinct()
