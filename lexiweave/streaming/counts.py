"""Word counts over articles that keep arriving: without end, or by windows of event time that are closed and forgotten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wikitext import strip_noise, tokens
from ..operators.features import article_tokens


def arriving_articles(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(title, body) of Parquet articles as their files arrive in a folder."""
    return spark.readStream.schema("title string, body string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_term_frequencies(articles: DataFrame) -> DataFrame:
    """(title, term, cnt) so far; for output mode update or complete. The state is the result, so it grows with the articles; for streams
    without end use windowed_counts()."""
    return article_tokens(articles).groupBy("title", "term").count().withColumnRenamed("count", "cnt")


def windowed_counts(articles: DataFrame, at: str = "at", window: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, n_articles, n_tokens) of each window of event time, for output mode append: a window comes out, and its state goes, once an
    article has come that is ``late`` beyond its end; articles later than that are left out.

    articles: (body, at), at a timestamp. Null bodies have no tokens; articles without a time are in no window.
    """
    d = articles.withWatermark(at, late).withColumn("_n", F.coalesce(F.size(tokens(strip_noise(F.col("body")))), F.lit(0)))
    w = d.groupBy(F.window(at, window)).agg(F.count(F.lit(1)).alias("n_articles"), F.sum("_n").alias("n_tokens"))
    return w.select(F.col("window.start").alias("start"), "n_articles", "n_tokens")
