"""Queries of the training-data operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, load
from .leakage import leaked_passages
from .mixing import Mix, count_tokens, mix_sources
from .neighbours import exact_neighbours, nearest_vectors, recall_of, unit_vectors
from .pii import passages, personal_information
from .subjects import subject_areas

#: The tokenizer file that counts tokens: a path of the driver, from which it is sent to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def word_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, unit) of every word with a usable vector."""
    words = load(spark, sf_dir, "words").filter(F.col("w_word").rlike(r"\S")).select("w_id").distinct()
    return unit_vectors(load(spark, sf_dir, "word_vectors").join(words, "w_id", "left_semi"), "w_id", "vec", 64)


def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, neighbour, cosine): the 5 most similar other words of every word with a usable vector."""
    return nearest_vectors(word_units(spark, sf_dir), k=5, dim=64)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_words(spark, sf_dir)
    return near.select(F.least("id", "neighbour").alias("w_id_a"), F.greatest("id", "neighbour").alias("w_id_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_words(spark, sf_dir)
    return near.select(F.col("id").alias("w_id"), F.col("neighbour").alias("similar_w_id"), F.round("cosine", 6).alias("cosine"))


def p1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar words of the query set (ids divisible by 50) by comparison with all words."""
    units = cut(word_units(spark, sf_dir), "units")
    near = exact_neighbours(units, units.filter("id % 50 = 0"), k=5, dim=64)
    return near.select(F.col("id").alias("w_id"), F.col("neighbour").alias("similar_w_id"))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the query set's 5 most similar words the search finds."""
    units = cut(word_units(spark, sf_dir), "units")
    exact = cut(exact_neighbours(units, units.filter("id % 50 = 0"), k=5, dim=64), "exact")
    return recall_of(nearest_vectors(units, k=5, dim=64), exact, 5)


P1_EXACT_SQL = r"""
WITH w AS (SELECT DISTINCT w_id FROM words WHERE regexp_matches(w_word, '\S')),
v AS (SELECT w_id, min(list_transform(vec, lambda x: x::DOUBLE)) AS vec FROM word_vectors SEMI JOIN w USING (w_id)
      WHERE len(vec) = 64 AND list_bool_and(list_transform(vec, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(vec, lambda x: x <> 0)) GROUP BY w_id),
c AS (SELECT a.w_id, b.w_id AS similar_w_id, list_cosine_similarity(a.vec, b.vec) AS cosine FROM v a JOIN v b ON a.w_id <> b.w_id AND a.w_id % 50 = 0)
SELECT w_id, similar_w_id FROM (SELECT *, row_number() OVER (PARTITION BY w_id ORDER BY cosine DESC, similar_w_id) AS r FROM c) WHERE r <= 5"""


def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_id, text): the documents, and the lines of the other articles, repeated lines once."""
    cols = [F.col("doc_id"), F.col("page_id").cast("bigint").alias("page_id")]
    docs = load(spark, sf_dir, "documents").select(*cols, "text")
    lines = load(spark, sf_dir, "article_lines").dropDuplicates(["doc_id", "line_no", "value"])
    return docs.unionByName(lines.select(*cols, F.col("value").alias("text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = load(spark, sf_dir, "categorylinks").filter("cl_from is not null and cl_to is not null")
    pages = links.select(F.col("cl_from").cast("bigint").alias("page_id"), F.col("cl_to").alias("title"))
    found, _ = subject_areas(
        article_texts(spark, sf_dir), load(spark, sf_dir, "doc_labels"), load(spark, sf_dir, "subjects"), pages
    )
    return found


def p2_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each subject in the corpus; a document of two subjects counts for both."""
    n = article_texts(spark, sf_dir).agg(F.countDistinct("doc_id").alias("n_all"))
    counts = p2_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"))
    return counts.join(F.broadcast(n)).select("subject", "n_documents", (F.col("n_documents") / F.col("n_all")).alias("share"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")
    return leaked_passages(docs, items, "doc_id", "text", "item_id", ["context", "question"])


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents that hold a passage of it."""
    items = load(spark, sf_dir, "eval_items").select(F.col("item_id").cast("bigint").alias("item_id"), "benchmark")
    n = p6_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.join(n, "item_id", "left").select("item_id", "benchmark", F.coalesce("n", F.lit(0)).alias("n_documents"))


_WORDS_SQL = r"regexp_extract_all(replace(strip_accents(lower({0})), 'ł', 'l'), '[\p{{L}}\p{{N}}]+')"
P6_FOUND_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL.format('text')} w FROM documents),
p AS (SELECT item_id, {_WORDS_SQL.format('context')} w FROM eval_items UNION ALL SELECT item_id, {_WORDS_SQL.format('question')} FROM eval_items),
dw AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) i FROM d WHERE len(w) >= 12)),
pw AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') k FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) i FROM p WHERE len(w) >= 12))
SELECT DISTINCT doc_id, CAST(item_id AS BIGINT) AS item_id FROM dw JOIN pw USING (k)"""
P6_ITEMS_SQL = f"""SELECT CAST(i.item_id AS BIGINT) AS item_id, benchmark, count(f.doc_id) AS n_documents
FROM eval_items i LEFT JOIN ({P6_FOUND_SQL}) f ON f.item_id = i.item_id GROUP BY ALL"""

def corpus_mix(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> Mix:
    docs = count_tokens(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", tokenizer)
    return mix_sources(docs, load(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_mix(spark, sf_dir).rows


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_mix(spark, sf_dir).report


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source with a target: its documents and share, whether no document is repeated too often, and whether the source has its share of
    the mix, to within one document, or gave every document as often as it may."""
    mix, targets = corpus_mix(spark, sf_dir), load(spark, sf_dir, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    whole = mix.rows.agg(F.sum("n_tokens").alias("whole"), F.max("n_tokens").alias("largest"))  # one row
    d = mix.report.join(F.broadcast(targets), "source").join(F.broadcast(whole))
    reached = F.col("mix_tokens") >= F.col("target_share") * F.col("whole") - F.col("largest")
    return d.select(
        "source", "n_documents", F.round("target_share", 9).alias("target_share"), (F.col("max_repeat") <= F.col("max_repeats")).alias("repeats_kept"),
        (reached | (F.col("mix_tokens") == F.col("n_tokens") * F.col("max_repeats"))).alias("share_or_all"),
    )


P7_LIMITS_SQL = """
WITH t AS (SELECT lower(trim(source)) source, target_share FROM mix_targets WHERE source IS NOT NULL),
d AS (SELECT lower(trim(source)) source, count(*) n FROM documents GROUP BY 1)
SELECT source, coalesce(n, 0) AS n_documents, round(target_share / (SELECT sum(target_share) FROM t), 9) AS target_share, TRUE AS repeats_kept, TRUE AS share_or_all FROM t LEFT JOIN d USING (source)"""


def p8_plain_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The e-mail addresses among the passages that are written with an @ between letters, so that SQL can find them too."""
    return p8_found(spark, sf_dir).filter((F.col("pii_type") == "email") & F.col("pii_text").rlike(r"^[\w.+-]+@[\w.-]+$")).select("doc_id", "pii_text")


P8_PLAIN_EMAILS_SQL = r"""
SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9_.+-]*@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.[A-Za-z]{2,}')) AS pii_text FROM documents"""


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages(load(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.col("kind").alias("pii_type"), F.col("passage").alias("pii_text")).distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text redacted and the number of passages replaced."""
    found = personal_information(load(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.size("found").alias("n_passages"), "redacted")


QUERIES = {
    "p1_found": (p1_found, None),
    "p1_neighbours": (p1_neighbours, None),
    "p1_exact": (p1_exact, P1_EXACT_SQL),
    "p1_recall": (p1_recall, None),
    "p2_found": (p2_found, None),
    "p2_composition": (p2_composition, None),
    "p6_found": (p6_found, P6_FOUND_SQL),
    "p6_items": (p6_items, P6_ITEMS_SQL),
    "p7_mix": (p7_mix, None),
    "p7_report": (p7_report, None),
    "p7_limits": (p7_limits, P7_LIMITS_SQL),
    "p8_plain_emails": (p8_plain_emails, P8_PLAIN_EMAILS_SQL),
    "p8_found": (p8_found, None),
    "p8_redacted": (p8_redacted, None),
}
