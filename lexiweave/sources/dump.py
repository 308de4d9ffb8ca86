"""Articles: XML dumps, folders of texts, samples, upserts and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wikitext import base_name, sanitize_title

PAGE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("revision", T.StructType([T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())]))])),
])


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, body, index): the pages of an XML dump; index counts from 0 in the order of the file.

    A text of nothing but blanks is read as empty; all other texts keep their blanks."""
    pages = spark.read.format("xml").option("rowTag", "page").option("attributePrefix", "@").option("ignoreSurroundingSpaces", False).schema(PAGE).load(path)
    rows = pages.select("title", F.coalesce("revision.text._VALUE", F.lit("")).alias("body"))
    return number_rows(rows)


def write_dump(articles: DataFrame, path: str) -> None:
    """(title, body) as an XML dump of pages, one file per partition."""
    pages = articles.select("title", F.struct(F.struct(F.col("body").alias("_VALUE")).alias("text")).alias("revision"))
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("attributePrefix", "@").save(path)


def number_rows(df: DataFrame, name: str = "index") -> DataFrame:
    """df with a dense number from 0 in the order of its partitions: sizes of partitions are counted
    first, so no row is shuffled; one row per partition is broadcast."""
    df = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    at, starts = 0, []
    for r in df.select(part.alias("p")).groupBy("p").count().orderBy("p").collect():
        starts.append((r["p"], at))
        at += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_p bigint, _at bigint")
    numbered = df.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return numbered.withColumn(name, F.col("_at") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_at")


def positional_sample(df: DataFrame, start: int = -1, skip: int = -1, most: int = -1, index: str = "index") -> DataFrame:
    """Rows by position: from ``start``, leaving out ``skip`` after each, below the absolute index ``most``;
    -1 means unset, and skip counts only with start."""
    keep = F.lit(True)
    if start >= 0:
        keep = keep & (F.col(index) >= start)
        if skip >= 0:
            keep = keep & ((F.col(index) - start) % (skip + 1) == 0)
    if most >= 0:
        keep = keep & (F.col(index) < most)
    return df.filter(keep)


def upsert_articles(df: DataFrame, title: str = "title", body: str = "body", order: str = "index") -> DataFrame:
    """(title, body): titles sanitized; of equal titles the last by order."""
    return df.groupBy(sanitize_title(F.col(title)).alias("title")).agg(F.max_by(body, order).alias("body"))


def write_articles(df: DataFrame, path: str, push: bool = False) -> None:
    """Parquet sink; push replaces what is there, otherwise rows are added."""
    df.write.mode("overwrite" if push else "append").parquet(path)


def read_article_folder(spark: SparkSession, path: str, strip_extension: bool = True) -> DataFrame:
    """(title, body): one text file per article, the title from the file's name. Empty files are no articles."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("title"), F.col("value").alias("body"))
    name = F.url_decode(F.regexp_replace("title", r"\+", "%2B"))
    return d.select((base_name(name) if strip_extension else name).alias("title"), "body")


def write_article_folder(articles: DataFrame, path: str) -> int:
    """(title, body) as one text file per article, named by the title, slashes as underscores; the number written.
    Of equal titles any one stands; null and empty titles are left out, null bodies are empty. path: a folder on any file system that
    all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        for b in batches:
            for title, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.open_output_stream(f"{root}/{title.replace('/', '_')}") as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return articles.filter("title <> ''").select("title", "body").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
