"""Command line: python -m lexiweave.cli VERB ...

dump XML OUT [--start N [--skip N]] [--max N] [--push]   pages of a dump as Parquet articles
wordcount ARTICLES OUT [--dictionary FILE]               term frequencies and categories
classify NEW CORPUS OUT                                  similarities of the new article to the corpus
classify --auto NEW_ARTICLES ARTICLES WORK               word counts where missing, similarities, labels
bestCategories SIMILARITIES [K]                          predicted labels
fold COUNTS OUT                                          counts and categories in folders by fold
crossvalidate FOLDS OUT                                  predicted labels of every article from the other folds
crossvalidate --pairs FOLDS OUT                          similarities of the articles of every fold to those of the others
crossvalidate --auto ARTICLES WORK                       word counts where missing, folds, labels, scores, average
cvscores PREDICTED FOLDS OUT                             per-article metrics
cvscores --auto WORK                                     metrics and average of an earlier crossvalidate --auto
cvaverage SCORES OUT                                     their average
All verbs take --properties FILE. Paths name their file system, so --local changes nothing. Exit code 0 on success.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import evaluate, features, knn, similarity
from .session import finished, has_files
from .sources import dump, tables


def _articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles from Parquet, an XML dump, or a folder with one text file per article."""
    if path.endswith(".xml"):
        return dump.upsert_articles(dump.read_dump(spark, path))
    if finished(spark, path) or has_files(spark, path, "*.parquet"):
        return spark.read.parquet(path).select("title", "body")
    return dump.read_article_folder(spark, path, strip_extension=False)


def _word_count(spark: SparkSession, source: str, out: str, s: Settings) -> None:
    a = _articles(spark, source)
    d = tables.read_dictionary(spark, s.dictionary_location) if s.dictionary_location else None
    features.term_frequencies(a, d, s.strip_extension).write.mode("overwrite").parquet(f"{out}/tf")
    features.article_categories(a, s.strip_extension).write.mode("overwrite").parquet(f"{out}/cats")


def _counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/tf"), spark.read.parquet(f"{path}/cats")


def _fold(spark: SparkSession, counts: str, out: str, s: Settings) -> None:
    for name, d in zip(("tf", "cats"), _counts(spark, counts)):
        tables.write_folds(evaluate.assign_folds(d, s.folds, s.random_per_fold), f"{out}/{name}")


def _cross_validate(spark: SparkSession, folds: str, out: str, s: Settings) -> None:
    tf, cats = tables.read_folds(spark, f"{folds}/tf"), tables.read_folds(spark, f"{folds}/cats")
    where = tf.select("title", "fold").distinct()
    p = evaluate.cv_predict(tf.drop("fold"), cats.drop("fold"), where, s.k, s.classifier_precision)
    p.write.mode("overwrite").parquet(out)


def _pairs(spark: SparkSession, folds: str, out: str, s: Settings) -> None:
    """The pairs of every fold, each from its own folder and those of the other folds."""
    cats = tables.read_folds(spark, f"{folds}/cats").drop("fold")
    for f in range(s.folds):
        test, train = tables.read_folds(spark, f"{folds}/tf", test=f), tables.read_folds(spark, f"{folds}/tf", train=f)
        evaluate.fold_pairs(test, train, cats).write.mode("overwrite").parquet(f"{out}/fold={f}")


def _classify(spark: SparkSession, corpus: str, new: str, out: str, s: Settings) -> None:
    """Similarities of the new articles; repeated as often as the settings say, to be timed."""
    tf, cats = _counts(spark, corpus)
    for _ in range(s.classify_repetitions):
        started = time.perf_counter()
        similarity.similarities(tf, cats, _counts(spark, new)[0]).write.mode("overwrite").parquet(out)
        best = knn.top_k(spark.read.parquet(out), s.k).count()
        if s.classify_repetitions > 1:
            print(f"{best} neighbours in {time.perf_counter() - started:.1f} s", file=sys.stderr)


def _scores(spark: SparkSession, predicted: str, folds: str, out: str) -> None:
    cats = tables.read_folds(spark, f"{folds}/cats").drop("fold")
    evaluate.compare(features.category_lists(cats), spark.read.parquet(predicted)).write.mode("overwrite").parquet(out)


def _score_and_average(spark: SparkSession, work: str) -> None:
    _scores(spark, f"{work}/predicted", f"{work}/folds", f"{work}/scores")
    _show(evaluate.cv_average(spark.read.parquet(f"{work}/scores")))


def _show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(*row, sep="\t")


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="lexiweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("dump", "wordcount", "classify", "bestCategories", "fold", "crossvalidate", "cvscores", "cvaverage"):
        v = verbs.add_parser(verb)
        v.add_argument("args", nargs="+")
        v.add_argument("--properties")
        v.add_argument("--auto", action="store_true")
        v.add_argument("--push", action="store_true")
        v.add_argument("--local", action="store_true")
        v.add_argument("--pairs", action="store_true")
        v.add_argument("--dictionary")
        for n in ("--start", "--skip", "--max"):
            v.add_argument(n, type=int, default=-1)
    o = top.parse_args(argv)
    s = Settings.from_properties(Path(o.properties).read_text()) if o.properties else Settings()
    if o.dictionary:
        s = Settings(**{**vars(s), "dictionary_location": o.dictionary})
    need = {"dump": 2, "wordcount": 2, "classify": 3, "bestCategories": 1, "fold": 2, "crossvalidate": 2, "cvscores": 3, "cvaverage": 2}[o.verb]
    if o.verb == "cvscores" and o.auto:
        need = 1
    if len(o.args) < need:
        top.error(f"{o.verb} needs {need} paths")
    spark = spark or SparkSession.builder.appName("lexiweave").getOrCreate()
    a = o.args
    if o.verb == "dump":
        sample = dump.positional_sample(dump.read_dump(spark, a[0]), o.start, o.skip, o.max)
        dump.write_articles(dump.upsert_articles(sample), a[1], o.push)
    elif o.verb == "wordcount":
        _word_count(spark, a[0], a[1], s)
    elif o.verb == "classify":
        new, corpus, out = a[0], a[1], a[2]
        if o.auto:
            for source, work in ((new, f"{out}/new"), (corpus, f"{out}/corpus")):
                if not finished(spark, f"{work}/cats"):
                    _word_count(spark, source, work, s)
            new, corpus, out = f"{out}/new", f"{out}/corpus", f"{out}/similarities"
        _classify(spark, corpus, new, out, s)
        if o.auto:
            _show(knn.predict(spark.read.parquet(out), s.k, s.classifier_precision).orderBy("query", F.desc("votes"), "category"))
    elif o.verb == "bestCategories":
        k = int(a[1]) if len(a) > 1 else s.k
        _show(knn.predict(spark.read.parquet(a[0]), k, s.classifier_precision).orderBy("query", F.desc("votes"), "category"))
    elif o.verb == "fold":
        _fold(spark, a[0], a[1], s)
    elif o.verb == "crossvalidate":
        if o.auto:
            work = a[1]
            if not finished(spark, f"{work}/counts/cats"):
                _word_count(spark, a[0], f"{work}/counts", s)
            _fold(spark, f"{work}/counts", f"{work}/folds", s)
            _cross_validate(spark, f"{work}/folds", f"{work}/predicted", s)
            _score_and_average(spark, work)
        else:
            (_pairs if o.pairs else _cross_validate)(spark, a[0], a[1], s)
    elif o.verb == "cvscores" and o.auto:
        if not finished(spark, f"{a[0]}/predicted"):
            print("crossvalidate --auto has not run there", file=sys.stderr)
            return 1
        _score_and_average(spark, a[0])
    elif o.verb == "cvscores":
        _scores(spark, a[0], a[1], a[2])
    else:
        evaluate.cv_average(spark.read.parquet(a[0])).write.mode("overwrite").parquet(a[1])
        _show(spark.read.parquet(a[1]))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
