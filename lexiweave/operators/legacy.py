"""Legacy relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix_row(line: Column) -> Column:
    """``article# id-count id-count ...`` as array<struct<article_id, word_id, cnt>>; parts that do not parse go."""
    article = F.trim(F.substring_index(line, "#", 1)).try_cast("int")
    parts = F.filter(F.split(F.substr(line, F.instr(line, "#") + 1), " "), lambda x: x != "")
    rows = F.transform(parts, lambda x: F.struct(
        article.alias("article_id"), F.substring_index(x, "-", 1).try_cast("int").alias("word_id"), F.substring_index(x, "-", -1).try_cast("int").alias("cnt")
    ))
    return F.filter(rows, lambda r: r["word_id"].isNotNull() & r["cnt"].isNotNull())


def parse_matrix(rows: DataFrame, line: str = "value") -> DataFrame:
    """(article_id, word_id, cnt) of matrix lines."""
    return rows.select(F.inline(matrix_row(F.col(line))))


def category_page_view(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(cl_to, page_title) of every link whose page exists, as often as it is linked and delivered."""
    return links.join(pages, links["cl_from"] == pages["page_id"]).select("cl_to", "page_title")


def top_categories(rows: DataFrame, k: int = 3) -> DataFrame:
    """(category, n): the k most frequent categories; ties go to the smaller name."""
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(k)


def dictionary_words(lines: DataFrame, word: str = "word") -> DataFrame:
    """Distinct words in lower case, sorted."""
    return lines.select(F.lower(word).alias(word)).filter(F.col(word).isNotNull()).distinct().orderBy(word)


def overlap_score(expected: Column, predicted: Column) -> Column:
    """The legacy score of two label arrays: common labels times two, divided by the expected, times the predicted."""
    return F.try_divide(F.size(F.array_intersect(expected, predicted)) * 2, F.size(expected)) * F.size(predicted)
