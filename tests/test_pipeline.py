import math
import random

import pytest
from pyspark.sql import functions as F

from lexiweave.config import Settings
from lexiweave.operators import evaluate, features, knn, legacy, similarity
from lexiweave.plans import articles
from lexiweave.streaming.counts import arriving_articles, running_term_frequencies

TF = "title string, term string, cnt bigint"


def test_cosine(spark):
    a = spark.createDataFrame([("A", str(t), c) for t, c in ((1, 2), (2, 3), (3, 2), (4, 2))], TF)
    b = spark.createDataFrame([("B", str(t), c) for t, c in ((2, 2), (4, 3), (1, 4))], TF)
    cats = spark.createDataFrame([("A", "x")], "title string, category string")
    (row,) = similarity.similarities(a, cats, b).collect()
    assert row.similarity == pytest.approx(20 / 609**0.5, abs=1e-15) and row.query == "B" and row.categories == ["x"]


def test_include_zero_and_uncategorized(spark):
    tf = spark.createDataFrame([("A", "x", 1), ("B", "y", 1), ("C", "x", 5)], TF)
    cats = spark.createDataFrame([("A", "c"), ("B", "c")], "title string, category string")
    q = spark.createDataFrame([("Q", "x", 2)], TF)
    assert {(r.title, r.similarity) for r in similarity.similarities(tf, cats, q, include_zero=True).collect()} == {("A", 1.0), ("B", 0.0)}
    assert [r.title for r in similarity.similarities(tf, cats, q).collect()] == ["A"]


def test_vote_and_cut(spark):
    sim = spark.createDataFrame(
        [("q", "a", 0.5, ["A", "B"]), ("q", "b", 0.4, ["B"]), ("q", "c", 0.0, ["C"]), ("q", "d", float("nan"), ["D"])],
        "query string, title string, similarity double, categories array<string>",
    )
    assert [(r.category, r.votes) for r in knn.predict(sim, 3, 0.8).collect()] == [("B", 0.9)]
    assert sorted(r.category for r in knn.predict(sim, 3, 0.5).collect()) == ["A", "B"]
    assert knn.predict(sim.filter("title > 'b'"), 3, 0.5).count() == 0
    strict = knn.threshold(knn.vote(knn.top_k(sim, 3)), keep=lambda votes, most: votes > 0.6)
    assert [r.category for r in strict.collect()] == ["B"]


def test_ties_by_title(spark):
    sim = spark.createDataFrame([("q", t, 0.5, []) for t in "dbca"], "query string, title string, similarity double, categories array<string>")
    assert [r.title for r in knn.top_k(sim, 2).orderBy("rank").collect()] == ["a", "b"]


def test_metrics(spark):
    e = spark.createDataFrame([("x", ["A", "B"]), ("y", ["A", "A"]), ("z", ["A"]), ("n", [])], "title string, categories array<string>")
    p = spark.createDataFrame([("x", "B"), ("x", "C"), ("y", "A"), ("n", "A")], "test string, category string")
    got = {r.title: tuple(r)[1:] for r in evaluate.compare(e, p).collect()}
    assert got == {"x": (1, 1, 1, 0.5, 0.5, 0.5), "y": (2, 0, 0, 1.0, 1.0, 1.0)}
    s = evaluate.compare(e, p)
    assert tuple(evaluate.cv_average(s).first()) == (3, 1, 1, 0.75, 0.75, 0.75)
    assert evaluate.cv_average(s.limit(0)).count() == 0


def test_word_count_and_dictionary(spark):
    a = spark.createDataFrame([("t", "koty Koty pies koty"), ("", "kot"), (None, "kot"), ("u", None), ("v.", "as")], "title string, body string")
    d = spark.createDataFrame([("koty", "kocur"), ("pies", "")], "form string, lexeme string")
    got = {(r.title, r.term, r.cnt) for r in features.term_frequencies(a, d).collect()}
    assert got == {("t", "kocur", 2), ("t", "Koty", 1), ("v.", "as", 1)}
    assert ("v", "as", 1) in {tuple(r) for r in features.term_frequencies(a, None, strip_extension=True).collect()}


def test_nearest_articles_is_exact(spark):
    rng = random.Random(3)
    rows = [(f"d{i}", f"w{int(rng.paretovariate(0.7)) % 40}", rng.randint(1, 4)) for i in range(120) for _ in range(12)]
    tf = spark.createDataFrame(rows, TF).groupBy("title", "term").agg(F.sum("cnt").alias("cnt"))
    cats = spark.createDataFrame([(f"d{i}", f"c{i % 5}") for i in range(0, 120) if i % 7], "title string, category string")
    folds = evaluate.assign_folds(tf.select("title").distinct())
    pairs = knn.top_k(evaluate.cv_pairs(tf, cats, folds), 3, "test", "train")
    near = similarity.nearest_articles(tf, folds, cats.select("title"), cats.select("title"), 3, block_rows=17)
    a = sorted((r.test, r.train, round(r.similarity, 12)) for r in pairs.collect())
    assert a == sorted((r.test, r.train, round(r.similarity, 12)) for r in near.collect()) and len(a) > 300


def test_empty_corpus(spark):
    tf = spark.createDataFrame([], TF)
    cats = spark.createDataFrame([], "title string, category string")
    folds = evaluate.assign_folds(tf.select("title"))
    assert evaluate.cv_scores(tf, cats, folds).count() == 0
    assert similarity.similarities(tf, cats, tf).count() == 0


def test_article_vectors(spark):
    tf = spark.createDataFrame([("t", "sofa", 1), ("t", "krzeslo", 2)], TF)
    cats = spark.createDataFrame([("t", "Dom")], "title string, category string")
    (r,) = features.article_vectors(tf, cats).collect()
    assert r.terms == {"sofa": 1, "krzeslo": 2} and r.categories == ["Dom"]


def test_legacy(spark):
    d = spark.createDataFrame([("1# 1-3 3-5 5-12 34-5",), ("x",), (None,), ("2# 7-x 8-9",)], "value string")
    assert sorted(tuple(r) for r in legacy.parse_matrix(d).collect() if r.article_id) == [(1, 1, 3), (1, 3, 5), (1, 5, 12), (1, 34, 5), (2, 8, 9)]
    rows = spark.createDataFrame([(c,) for c in "bbaaccd"], "category string")
    assert [tuple(r) for r in legacy.top_categories(rows).collect()] == [("a", 2), ("b", 2), ("c", 2)]
    score = spark.range(1).select(legacy.overlap_score(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))).first()[0]
    assert score == 1.0


def test_settings():
    s = Settings.from_properties("# x\na.b.k=5\na.b.classifierPrecision=-1\na.randomPerFold = 4\nfolds=3\nclassifyRepetitions=0\n")
    assert (s.k, s.classifier_precision, s.random_per_fold, s.folds, s.classify_repetitions) == (5, 0.8, 4, 3, 1)
    assert Settings.from_properties("x.classifierPrecision=abc").classifier_precision == 0.8


def test_streaming_word_count(spark, tmp_path):
    spark.createDataFrame([("t", "ala ma kota ala")], "title string, body string").write.parquet(str(tmp_path / "in"))
    q = running_term_frequencies(arriving_articles(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("wc").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.term, r.cnt) for r in spark.table("wc").collect()} == {("ala", 2), ("ma", 1), ("kota", 1)}


def test_product_in_blocks_and_with_zeros(spark):
    """Blocks of two vectors, a term that all share, ties, an article without terms, a query without match."""
    tf = spark.createDataFrame([(f"a{i}", t, c) for i in range(7) for t, c in (("w", 1), (f"t{i % 3}", 2))], "title string, term string, cnt bigint")
    cats = spark.createDataFrame([(f"a{i}", "Z") for i in range(7)] + [("empty", "Z")], "title string, category string")
    queries = tf.filter("title = 'a0'").unionByName(spark.createDataFrame([("q", "nowhere", 1)], tf.schema))
    near = {(r.query, r.title): round(r.similarity, 9) for r in similarity.similarities(tf, cats, queries).collect()}
    assert near == {("a0", f"a{i}"): 1.0 if i % 3 == 0 else 0.2 for i in range(7)}
    whole = {(r.query, r.title): round(r.similarity, 9) for r in similarity.similarities(tf, cats, queries, include_zero=True).collect()}
    assert len(whole) == 16 and whole[("q", "a1")] == 0 and whole[("a0", "empty")] == 0 and near.items() <= whole.items()
    v = similarity.sparse_vectors(tf).withColumn("part", F.lit(None).cast("int"))
    for k in (None, 2):
        got = similarity.product(v, v, k, block_rows=2)
        got = knn.top_k(got.withColumnsRenamed({"left": "query", "right": "title"}), k) if k else got.select("*")
        assert got.count() == (14 if k else 49)
    assert similarity.product(v.limit(0), v).count() == 0


def test_too_many_queries_with_all_articles(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MOST_QUERIES", 1)
    tf = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "title string, term string, cnt bigint")
    cats = spark.createDataFrame([("a", "Z")], "title string, category string")
    with pytest.raises(ValueError):
        similarity.similarities(tf, cats, tf, include_zero=True)


def test_cv_pairs_never_travel(spark):
    """A vector is stored once for all pairs of blocks, and no exchange or join follows the pairs."""
    tf = spark.createDataFrame([(f"d{i}", t, 1) for i in range(40) for t in ("w", f"t{i % 3}")], TF)
    cats = spark.createDataFrame([(f"d{i}", "Z") for i in range(40)], "title string, category string")
    pairs = evaluate.cv_pairs(tf, cats, evaluate.assign_folds(tf.select("title").distinct()))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" not in plan
    fold = {r.title: r.fold for r in evaluate.assign_folds(tf.select("title").distinct()).collect()}
    expected = {(fold[a], a, b, 1.0 if int(a[1:]) % 3 == int(b[1:]) % 3 else 0.5) for a in fold for b in fold if fold[a] != fold[b]}
    assert {(r.fold, r.test, r.train, round(r.similarity, 9)) for r in pairs.collect()} == expected


def test_product_of_rare_and_frequent_terms(spark, monkeypatch):
    """The dense part, the postings and large counts give the same exact sums."""
    rng = random.Random(5)
    counts = {(f"d{i}", f"w{int(rng.paretovariate(0.8)) % 60}"): rng.choice((1, 2, 5, 90_000)) for i in range(60) for _ in range(15)}
    tf = spark.createDataFrame([(*x, c) for x, c in counts.items()], TF)
    v = similarity.sparse_vectors(tf).withColumn("part", F.lit(None).cast("int"))
    of = {}
    for (title, term), c in counts.items():
        of.setdefault(title, {})[term] = c
    norm = {t: math.sqrt(sum(c * c for c in x.values())) for t, x in of.items()}
    exact = {(s, t): sum(c * of[t].get(w, 0) for w, c in of[s].items()) / (norm[s] * norm[t]) for s in of for t in of}
    for dense, most in ((0.0, 1024), (0.2, 3), (1.0, 0)):
        monkeypatch.setattr(similarity, "DENSE", dense)
        monkeypatch.setattr(similarity, "MOST_DENSE", most)
        a, b = (next(similarity.pack(iter(v.select("title", "v", "part", "q", F.lit(0).alias("block")).toArrow().to_batches()))).column("data")[0].as_buffer() for _ in range(2))
        for k in (None, 3):
            got = [(r["left"], r["right"], r["similarity"]) for x in similarity.compare(similarity.pickle.loads(a), similarity.pickle.loads(b), k, False) for r in x.to_pylist()]
            best = {(s, t): x for (s, t), x in exact.items() if x > 0}
            if k:
                best = {p: best[p] for s in of for p in sorted((p for p in best if p[0] == s), key=lambda p: (-best[p], p[1]))[:k]}
            assert {(s, t): x for s, t, x in got} == best


def test_any_number_of_queries_with_all_articles(spark):
    """More queries than were once allowed; the categories are not joined to the pairs if they are not wanted."""
    tf = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], TF)
    cats = spark.createDataFrame([("a", "Z"), ("b", "Z")], "title string, category string")
    queries = spark.range(10_001).selectExpr("concat('q', id) AS title", "if(id % 2 = 0, 'x', 'z') AS term", "1L AS cnt")
    whole = similarity.similarities(tf, cats, queries, include_zero=True, categories=False)
    assert whole.columns == ["query", "title", "similarity"] and "SortMergeJoin" not in whole._jdf.queryExecution().executedPlan().toString()
    assert {(r.title, r.similarity): r["count"] for r in whole.groupBy("title", "similarity").count().collect()} == {("a", 1.0): 5001, ("a", 0.0): 5000, ("b", 0.0): 10_001}


def test_blocks_meet_once_for_both_directions(spark, monkeypatch):
    """One set on both sides: the same neighbours as for two sets, ties and folds included, from half of the pairs of blocks."""
    rng = random.Random(7)
    rows = {(f"d{i}", f"w{int(rng.paretovariate(0.7)) % 30}"): rng.randint(1, 3) for i in range(150) for _ in range(6)}
    tf = spark.createDataFrame([(*x, c) for x, c in rows.items()], TF)
    titles = tf.select("title").distinct()
    folds, other = evaluate.assign_folds(titles), titles.select("title")
    for k in (1, 2, 5):
        one = similarity.nearest_articles(tf, folds, titles, titles, k, block_rows=40)
        two = similarity.nearest_articles(tf, folds, titles, other, k, block_rows=40)
        assert "(i#" in one._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    monkeypatch.setattr(similarity, "TILE", 64)
    a, b = (next(similarity.pack(iter(similarity.sparse_vectors(tf).filter(f"title {s} 'd5'").selectExpr("title", "v", "-1 AS part", "q", "0 AS block").toArrow().to_batches()))).column("data")[0].as_buffer() for s in ("<", ">="))
    a, b = similarity.pickle.loads(a), similarity.pickle.loads(b)
    got = [tuple(r.values()) for x in similarity.compare(a, b, 2, False, both=True) for r in x.to_pylist()]
    assert sorted(got, key=str) == sorted((tuple(r.values()) for one, other in ((a, b), (b, a)) for x in similarity.compare(one, other, 2, False) for r in x.to_pylist()), key=str)


def disk(spark, run):
    """Bytes that run() shuffles and stores."""
    spark.sparkContext.setJobGroup("disk", "disk")
    try:
        run()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    stages = [store.lastStageAttempt(i) for i in {i for j in tracker.getJobIdsForGroup("disk") for i in tracker.getJobInfo(j).stageIds}]
    return sum(x.shuffleWriteBytes() + x.outputBytes() for x in stages)


@pytest.fixture(scope="session")
def many_documents(spark, tmp_path_factory):
    """Documents of words of a small vocabulary in eight files, and their size."""
    path = tmp_path_factory.mktemp("many")
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnoprstuwyz", k=7)) for _ in range(3000)]
    rows = [(i, " ".join(words[int(rng.paretovariate(0.6)) % 3000] for _ in range(150)) + ("\n[[Kategoria:K]]" if i % 2 else "")) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8).write.parquet(f"{path}/documents.parquet")
    return str(path), sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_cosine_to_query_disk(spark, many_documents):
    """What is shuffled and stored beside the result stays below twice the input; it was several times that."""
    path, size = many_documents
    frames = []
    used = disk(spark, lambda: frames.append(articles.cosine_to_query(spark, path)))
    assert used < 2 * size
    assert frames[0].count() == 80 * 2000


def test_cv_pairs_disk(spark, many_documents):
    """What is shuffled and stored beside the pairs stays below twice the input; it was several times that."""
    path, size = many_documents
    frames = []
    used = disk(spark, lambda: frames.append(articles.cv_pairs(spark, path)))
    assert used < 2 * size
    fold = [r.n for r in articles.folded(spark, path).filter("substring(title, 5) % 2 = 1").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert frames[0].count() == 2000 * 2000 - sum(n * n for n in fold)


def test_article_product_of_odd_articles(spark, monkeypatch):
    """Rows of one title are one article, whichever of them has the category; null and empty titles and texts; blocks that turn out larger than planned."""
    rng = random.Random(13)
    text = [" ".join(f"w{'abcdefgh'[int(rng.paretovariate(0.8)) % 8]}x" for _ in range(rng.randint(0, 9))) for _ in range(60)]
    rows = [(f"d{i % 40}", x + (" [[Kategoria:K]]" if i % 3 == 0 else "")) for i, x in enumerate(text)]
    rows += [("null", None), ("none", "[[Kategoria:K]]"), (None, "wax [[Kategoria:K]]"), ("", "wax [[Kategoria:K]]")]
    a = spark.createDataFrame(rows, "title string, body string").repartition(5).withColumns({"part": F.lit(None).cast("int"), "query": F.col("title").rlike("[05]$|n")})
    tf, cats = features.term_frequencies(a), features.article_categories(a)
    queries = tf.join(a.filter("query").select("title").distinct(), "title", "left_semi")
    for most in (16384, 3):
        monkeypatch.setattr(similarity, "BLOCK_TERMS", 4_000_000 if most > 3 else 10)
        for zeros in (True, False):
            expected = sorted((r.query, r.title, r.similarity) for r in similarity.similarities(tf, cats, queries, include_zero=zeros).collect())
            got = sorted((r.left, r.right, r.similarity) for r in similarity.article_product(a, zeros, most).collect())
            assert got == expected and len(got) > 100
        both = similarity.article_product(a.withColumn("part", (F.crc32("title") % 3).cast("int")).drop("query"), block_rows=most)
        folds = a.select("title", ((F.crc32("title") % 3).cast("int")).alias("fold")).filter("title <> ''").distinct()
        expected = sorted(tuple(r) for r in evaluate.cv_pairs(tf, cats, folds).collect())
        assert sorted((r.part, r.left, r.right, r.similarity) for r in both.collect()) == expected and len(expected) > 100
    assert similarity.article_product(a.limit(0)).count() == 0
