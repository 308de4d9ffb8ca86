"""Dictionaries, intermediate rows as text, fold folders and the legacy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dump import number_rows

#: Fixed value: the marker of category rows in text files of word counts.
CATEGORY_MARK = "::Cat"
#: The columns of the score rows and of the legacy tables.
SCORES = "title string, tp int, fp int, fn int, sensitivity double, precision double, f_measure double"
CATEGORYLINKS = "cl_id decimal(8), cl_from decimal(8), cl_to string, cl_sortkey string, cl_timestamp timestamp, cl_sortkey_prefix string, cl_collation string, cl_type string"
PAGES = "page_id decimal(8), page_namespace decimal(11), page_title string, page_restrictions string, page_counter decimal(20), page_is_redirect decimal(1), page_is_new decimal(1), page_random double, page_touched string, page_latest decimal(8), page_len decimal(8), page_no_title_convert decimal(1)"
WORDS = "w_id bigint, w_word string"


def last_form_wins(rows: DataFrame, order: str) -> DataFrame:
    """(form, lexeme), one row per form: the last by order; empty and null forms and null lexemes are left out."""
    rows = rows.filter("form <> '' and lexeme is not null")
    return rows.groupBy("form").agg(F.max_by("lexeme", order).alias("lexeme"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(form, lexeme) of a tab-separated file; lines with fewer than two fields are ignored, further fields too."""
    lines = number_rows(spark.read.text(path)).withColumn("f", F.split("value", "\t"))
    rows = lines.filter(F.size("f") >= 2).select(F.col("f")[0].alias("form"), F.col("f")[1].alias("lexeme"), "index")
    return last_form_wins(rows, "index")


def write_term_rows(tf: DataFrame, cats: DataFrame, path: str, push: bool = True) -> None:
    """Word counts and categories in one folder of tab-separated text: title, term, count; title, mark, category."""
    rows = tf.select("title", "term", F.col("cnt").cast("string").alias("value"))
    rows = rows.unionByName(cats.select("title", F.lit(CATEGORY_MARK).alias("term"), F.col("category").alias("value")))
    rows.write.mode("overwrite" if push else "append").csv(path, sep="\t", quote="", escape="")


def read_term_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tf, cats) of a folder written by write_term_rows()."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="title string, term string, value string")
    tf = rows.filter(F.col("term") != CATEGORY_MARK).select("title", "term", F.col("value").try_cast("bigint").alias("cnt"))
    cats = rows.filter(F.col("term") == CATEGORY_MARK).select("title", F.col("value").alias("category"))
    return tf.filter("cnt is not null"), cats


def write_folds(df: DataFrame, path: str, push: bool = True) -> None:
    """Parquet in one folder per fold, so that readers of a fold, or of all others, skip the rest."""
    df.write.mode("overwrite" if push else "append").partitionBy("fold").parquet(path)


def read_folds(spark: SparkSession, path: str, test: int | None = None, train: int | None = None) -> DataFrame:
    """All folds, only fold ``test``, or all but fold ``train``."""
    d = spark.read.parquet(path)
    if test is not None:
        d = d.filter(F.col("fold") == test)
    return d.filter(F.col("fold") != train) if train is not None else d


def read_legacy(spark: SparkSession, path: str, schema: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    """A legacy table exported as text, such as CATEGORYLINKS, PAGES or WORDS. multiline: quoted fields may hold line
    breaks, as sort keys do; a file is then read by one task."""
    return spark.read.csv(
        path, sep=sep, schema=schema, nullValue="\\N", emptyValue="", multiLine=multiline, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
