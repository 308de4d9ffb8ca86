"""Queries of the categorization pipeline over the article tables, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wikitext import CATEGORY, NOISE, TOKEN, base_name, category_names, sanitize_title, strip_noise, tokens
from ..operators import evaluate, features, knn, legacy, similarity
from ..session import cut, load, new_path, spread
from ..sources.dump import number_rows, positional_sample, read_article_folder, read_dump, upsert_articles, write_article_folder, write_dump
from ..streaming.counts import windowed_counts
from ..sources.tables import CATEGORY_MARK, CATEGORYLINKS, read_dictionary, read_folds, read_legacy, read_term_rows, write_folds, write_term_rows

# ---- shared inputs


def articles(spark: SparkSession, d: str) -> DataFrame:
    """(title, body): every document under the name doc_<id>."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))


def scanned_articles(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """articles() and more columns of documents; texts are shuffled to use all cores only if the table has fewer files than there are cores."""
    docs = load(spark, d, "documents")
    rows = docs.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("title"), F.col("text").alias("body"), *more)
    return rows if len(docs.inputFiles()) >= spark.sparkContext.defaultParallelism else spread(rows)


def tf_cats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = articles(spark, d)
    return features.term_frequencies(a), features.article_categories(a)


def cv_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """tf_cats() of the articles with a category. The bodies are shuffled by title, so that their tokens, of which there are far more, need no other shuffle."""
    a = articles(spark, d).repartition("title")
    have = a.filter(F.size(category_names(strip_noise(F.col("body")))) > 0)
    return features.term_frequencies(have), features.article_categories(a)


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """One lexeme per form. The table has no line order, so of several lexemes of a form the largest counts."""
    rows = load(spark, d, "dictionary").filter("form <> '' and lexeme is not null")
    return rows.groupBy("form").agg(F.max("lexeme").alias("lexeme"))


def query_tf(tf: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """The vectors of the query set: the documents with an id divisible by 50."""
    q = load(spark, d, "documents").filter("doc_id % 50 = 0").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("title"))
    return tf.join(q, "title", "left_semi")


def decimals(x: Column, digits: int = 12) -> Column:
    """x, at least 0, rounded as SQL twins round it; F.round() goes through decimal numbers, which costs more than the rest of a row."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def folded(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.assign_folds(articles(spark, d).select("title"))


def _q(s: str) -> str:
    return s.replace("'", "''")


_ART = "art AS (SELECT 'doc_' || doc_id AS title, coalesce(text, '') AS body FROM documents)"
_CLEAN = f"cl AS (SELECT title, regexp_replace(body, '{_q(NOISE)}', '', 'g') AS body FROM art)"
_NAME = r"split_part(regexp_replace(translate(replace(replace(regexp_replace(x, '\{\{.*\}\}', '', 'g'), '[[Kategoria:', ''), ']]', ''), chr(9), ' '), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '|', 1)"
_CATS = f"cats AS (SELECT title, category FROM (SELECT title, {_NAME} AS category FROM (SELECT title, unnest(regexp_extract_all(body, '{_q(CATEGORY)}')) AS x FROM cl)) WHERE category <> '')"
_TOK = f"tok AS (SELECT title, unnest(regexp_extract_all(regexp_replace(body, '{_q(CATEGORY)}', '', 'g'), '{_q(TOKEN)}')) AS term FROM cl)"
_TF = "tf AS (SELECT title, term, count(*) AS cnt FROM tok GROUP BY ALL)"
_LISTS = "li AS (SELECT title, list_sort(list(category)) AS categories FROM cats GROUP BY title)"
_BASE = f"WITH {_ART}, {_CLEAN}, {_CATS}, {_TOK}, {_TF}, {_LISTS}"
_NORM = "nm AS (SELECT title, sum(cnt * cnt) AS q FROM tf GROUP BY title)"
_QUERY = "qt AS (SELECT * FROM tf WHERE title IN (SELECT 'doc_' || doc_id FROM documents WHERE doc_id % 50 = 0))"
_SIM = """sim AS (SELECT a.query, a.title, a.dot / (sqrt(n.q::DOUBLE) * sqrt(m.q::DOUBLE)) AS similarity, li.categories FROM
 (SELECT qt.title AS query, tf.title, sum(tf.cnt * qt.cnt) AS dot FROM tf JOIN qt USING (term) GROUP BY ALL) a
 JOIN li ON li.title = a.title JOIN nm n ON n.title = a.title JOIN nm m ON m.title = a.query)"""
_KNN = "nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, title) AS rank FROM sim WHERE similarity > 0) WHERE rank <= 2)"
_FOLD = """fo AS (SELECT title, CAST((abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 100) // 10 AS INT) AS fold FROM (SELECT title,
 list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(title, '(?s).'), lambda x: unicode(x)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296) AS h FROM art))"""
_PAIRS = """pr AS (SELECT a.fold, a.test, a.train, a.dot / (sqrt(n.q::DOUBLE) * sqrt(m.q::DOUBLE)) AS similarity FROM
 (SELECT f1.fold, x.title AS test, y.title AS train, sum(x.cnt * y.cnt) AS dot FROM (SELECT tf.* FROM tf SEMI JOIN li USING (title)) x JOIN fo f1 ON f1.title = x.title
  JOIN (SELECT tf.* FROM tf SEMI JOIN li USING (title)) y ON x.term = y.term JOIN fo f2 ON f2.title = y.title AND f1.fold <> f2.fold GROUP BY ALL) a
 JOIN nm n ON n.title = a.test JOIN nm m ON m.title = a.train)"""
_CVKNN = "cn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY similarity DESC, train) AS rank FROM pr WHERE similarity > 0) WHERE rank <= 2)"
_CVVOTE = """cv AS (SELECT test, category, round(sum(similarity), 9) AS votes FROM (SELECT test, similarity, unnest(categories) AS category FROM cn JOIN li ON li.title = cn.train) GROUP BY ALL),
 cp AS (SELECT test, category, votes FROM (SELECT *, max(votes) OVER (PARTITION BY test) AS most FROM cv) WHERE round(votes / most, 9) >= 1.0)"""
_SCORE = """pp AS (SELECT test AS title, list(DISTINCT category) AS p FROM cp GROUP BY test),
 sc0 AS (SELECT title, CAST(len(list_filter(categories, lambda c: list_contains(p, c))) AS INT) AS tp, CAST(len(list_filter(p, lambda c: NOT list_contains(categories, c))) AS INT) AS fp,
  CAST(len(list_filter(categories, lambda c: NOT list_contains(p, c))) AS INT) AS fn FROM li JOIN pp USING (title)),
 sc AS (SELECT *, tp / (tp + fn) AS sensitivity, tp / (tp + fp) AS precision, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fn)) * (tp / (tp + fp)) / (tp / (tp + fn) + tp / (tp + fp)) ELSE 0.0 END AS f_measure
  FROM sc0 WHERE tp + fn > 0 AND tp + fp > 0)"""
_CV = f"{_BASE}, {_NORM}, {_FOLD}, {_PAIRS}, {_CVKNN}, {_CVVOTE}"
_DICT = "dict AS (SELECT form, max(lexeme) AS lexeme FROM dictionary WHERE form <> '' AND lexeme IS NOT NULL GROUP BY form)"

# ---- queries


def dense_index(spark, d):
    """(doc_id, title, index): the documents in the order of their ids, numbered from 0."""
    return number_rows(load(spark, d, "documents").select("doc_id", "title").orderBy("doc_id"))


def positional_sample_(spark, d):
    return positional_sample(dense_index(spark, d), 1, 2, 3000)


def title_sanitize(spark, d):
    t = F.col("page_title")
    return load(spark, d, "page").select(F.col("page_id").cast("bigint").alias("page_id"), sanitize_title(t).alias("title"), base_name(sanitize_title(t)).alias("base"))


def upsert_last_wins(spark, d):
    return upsert_articles(load(spark, d, "documents"), "title", "text", "doc_id").select("title", F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"))


def xml_dump(spark, d):
    """Every document written to an XML dump and read from it."""
    path = new_path(spark, "dump")
    write_dump(load(spark, d, "documents").select("title", F.col("text").alias("body")), path)
    return read_dump(spark, path).select("title", F.md5("body").alias("body_md5"))


def strip_noise_(spark, d):
    return articles(spark, d).select("title", strip_noise(F.col("body")).alias("clean"))


def extract_categories(spark, d):
    a = articles(spark, d).select("title", F.posexplode(category_names(strip_noise(F.col("body")))).alias("position", "category"))
    return a.select("title", F.col("position").cast("bigint").alias("position"), "category")


def tokenize(spark, d):
    return articles(spark, d).select("title", F.explode(tokens(strip_noise(F.col("body")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def word_count(spark, d):
    return features.term_frequencies(articles(spark, d))


def lemmatized_word_count(spark, d):
    return features.term_frequencies(articles(spark, d), dictionary(spark, d))


def article_vectors(spark, d):
    tf, cats = tf_cats(spark, d)
    v = features.article_vectors(tf, cats)
    total = F.aggregate(F.map_values("terms"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return v.select("title", F.size("terms").cast("bigint").alias("n_terms"), total.alias("n_tokens"), F.coalesce(F.size("categories"), F.lit(0)).cast("bigint").alias("n_categories")).filter("n_terms > 0")


def l2_norms(spark, d):
    return features.squared_norms(tf_cats(spark, d)[0]).select("title", "q", F.sqrt(F.col("q").cast("double")).alias("norm"))


def _sim(spark, d, **how):
    tf, cats = (cut(x, "counts") for x in tf_cats(spark, d))  # read several times below
    return similarity.similarities(tf, cats, query_tf(tf, spark, d), **how)


def cosine_to_query(spark, d):
    a = scanned_articles(spark, d, F.lit(None).cast("int").alias("part"), (F.col("doc_id") % 50 == 0).alias("query"))
    found = similarity.article_product(a, zeros=True)
    return found.select(F.col("left").alias("query"), F.col("right").alias("title"), decimals(F.col("similarity")).alias("similarity"))


def categorized_only(spark, d):
    tf, cats = tf_cats(spark, d)
    return tf.join(cats.select("title").distinct(), "title", "left_semi").groupBy("title").agg(F.sum("cnt").alias("n_tokens"))


def knn_top_k(spark, d):
    return knn.top_k(_sim(spark, d, k=2), 2).select("query", "title", F.round("similarity", 12).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def vote_and_cut(spark, d):
    return knn.predict(_sim(spark, d, k=2), 2, 1.0)


def assign_folds(spark, d):
    return folded(spark, d).select("title", "fold")


def fold_sizes(spark, d):
    return folded(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def cv_pairs(spark, d):
    return evaluate.article_pairs(scanned_articles(spark, d)).withColumn("similarity", decimals(F.col("similarity")))


def cv_predict(spark, d):
    tf, cats = cv_input(spark, d)
    return evaluate.cv_predict(tf, cats, folded(spark, d))


def cv_scores(spark, d):
    tf, cats = cv_input(spark, d)
    return evaluate.cv_scores(tf, cats, folded(spark, d))


def cv_average(spark, d):
    a = evaluate.cv_average(cv_scores(spark, d))
    return a.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("sensitivity", "precision", "f_measure")])


def category_page_view(spark, d):
    v = legacy.category_page_view(load(spark, d, "categorylinks"), load(spark, d, "page"))
    return v.groupBy("cl_to", "page_title").agg(F.count(F.lit(1)).alias("n"))


def top3_categories(spark, d):
    return legacy.top_categories(features.article_categories(articles(spark, d)), 3)


def matrix_rows(spark, d):
    v = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("c")))).alias("x"))
    lines = v.select(F.concat(F.col("o"), F.lit("# "), F.concat_ws(" ", F.transform("x", lambda y: F.concat(y["l_linenumber"], F.lit("-"), y["c"])))).alias("value"))
    return legacy.parse_matrix(lines)


def dictionary_words(spark, d):
    return legacy.dictionary_words(load(spark, d, "dictionary").select(F.col("form").alias("word")))


def fold_pruned_counts(spark, d):
    """Test and train sizes of every fold, from the folders of the fold and of the other folds."""
    path = new_path(spark, "folds")
    write_folds(folded(spark, d), path)
    parts = []
    for f in range(10):
        for side, rows in (("test", read_folds(spark, path, test=f)), ("train", read_folds(spark, path, train=f))):
            parts.append(rows.select(F.lit(f).alias("fold"), F.lit(side == "test").cast("bigint").alias("test"), F.lit(side == "train").cast("bigint").alias("train")))
    return reduce(DataFrame.unionByName, parts).groupBy("fold").agg(F.sum("test").alias("test"), F.sum("train").alias("train"))


def dictionary_file(spark, d):
    """The dictionary written as a tab-separated file, in the order of a hash of its lines, and read from it: the last line of a form counts."""
    path = new_path(spark, "dictionary")
    line = F.concat_ws("\t", F.coalesce("form", F.lit("")), F.coalesce("lexeme", F.lit("")))
    load(spark, d, "dictionary").select(line.alias("value")).orderBy(F.md5("value"), "value").coalesce(1).write.text(path)
    return read_dictionary(spark, path)


def term_rows(spark, d):
    """Word counts and categories written as rows of text, and read from them."""
    path = new_path(spark, "rows")
    write_term_rows(*tf_cats(spark, d), path)
    tf, cats = read_term_rows(spark, path)
    return tf.select("title", "term", F.col("cnt").cast("string").alias("value")).unionByName(cats.select("title", F.lit(CATEGORY_MARK).alias("term"), F.col("category").alias("value")))


def article_folder(spark, d):
    """Every document written as a file of its own, and read from the folder."""
    path = new_path(spark, "folder")
    write_article_folder(articles(spark, d), path)
    return read_article_folder(spark, path).select("title", F.md5("body").alias("body_md5"))


def legacy_links(spark, d):
    """The links written in the form of the legacy table, and read with its schema."""
    path = new_path(spark, "legacy")
    links = load(spark, d, "categorylinks")
    names = [c.split()[0] for c in CATEGORYLINKS.split(", ")]
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c == "cl_timestamp" else F.col(c).cast("string").alias(c) for c in names]
    links.select(*text).write.csv(path, nullValue="\\N", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = read_legacy(spark, path, CATEGORYLINKS, multiline=True)
    return back.select(F.col("cl_id").cast("bigint").alias("cl_id"), F.col("cl_from").cast("bigint").alias("cl_from"), "cl_to", F.date_format("cl_timestamp", "yyyy-MM-dd HH:mm:ss").alias("cl_timestamp"), "cl_type")


def overlap_scores(spark, d):
    """The legacy score of every article's predicted labels."""
    tf, cats = (cut(x, "counts") for x in tf_cats(spark, d))
    predicted = evaluate.cv_predict(tf, cats, folded(spark, d)).groupBy(F.col("test").alias("title")).agg(F.collect_set("category").alias("p"))
    both = features.category_lists(cats).join(predicted, "title")
    return both.select("title", legacy.overlap_score(F.col("categories"), F.col("p")).alias("score"))


def stream_weeks(spark, d):
    """Articles and tokens by week of revision, from a stream over the documents; weeks that the stream has not closed are still open."""
    source, out = new_path(spark, "arriving"), new_path(spark, "weeks")
    at = F.to_timestamp(F.date_format("rev_ts", "yyyy-MM-dd HH:mm:ss'Z'"), "yyyy-MM-dd HH:mm:ssX")  # times without zone as UTC
    load(spark, d, "documents").select("text", at.alias("at")).withColumnRenamed("text", "body").write.parquet(source)
    arriving = spark.readStream.schema("body string, at timestamp").parquet(source)
    weeks = windowed_counts(arriving, "at", "7 days", "1 day")
    run = weeks.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(weeks.schema).parquet(out).select(F.unix_timestamp("start").alias("week"), "n_articles", F.col("n_tokens").cast("bigint").alias("n_tokens"))


QUERIES = {
    "stream_weeks": (stream_weeks, f"""WITH x AS (SELECT CAST(floor(epoch(date_trunc('second', rev_ts)) / 604800) * 604800 AS BIGINT) AS week, date_trunc('second', rev_ts) AS ts,
        len(regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '{_q(NOISE)}', '', 'g'), '{_q(CATEGORY)}', '', 'g'), '{_q(TOKEN)}')) AS n FROM documents WHERE rev_ts IS NOT NULL)
        SELECT week, count(*) AS n_articles, CAST(sum(n) AS BIGINT) AS n_tokens FROM x GROUP BY week HAVING week + 604800 <= (SELECT max(epoch(ts)) FROM x) - 86400"""),
    "dense_index": (dense_index, "SELECT doc_id, title, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents"),
    "positional_sample": (positional_sample_, "SELECT * FROM (SELECT doc_id, title, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents) WHERE index >= 1 AND (index - 1) % 3 = 0 AND index < 3000"),
    "dictionary_file": (dictionary_file, """SELECT form, arg_max(lexeme, (md5(form || chr(9) || lexeme), form || chr(9) || lexeme)) AS lexeme
        FROM (SELECT coalesce(form, '') AS form, coalesce(lexeme, '') AS lexeme FROM dictionary) WHERE form <> '' GROUP BY form"""),
    "term_rows": (term_rows, f"{_BASE} SELECT title, term, CAST(cnt AS VARCHAR) AS value FROM tf UNION ALL SELECT title, '::Cat', category FROM cats"),
    "article_folder": (article_folder, "SELECT 'doc_' || doc_id AS title, md5(text) AS body_md5 FROM documents WHERE text <> ''"),
    "legacy_links": (legacy_links, "SELECT CAST(cl_id AS BIGINT) AS cl_id, CAST(cl_from AS BIGINT) AS cl_from, cl_to, strftime(cl_timestamp, '%Y-%m-%d %H:%M:%S') AS cl_timestamp, cl_type FROM categorylinks"),
    "overlap_scores": (overlap_scores, f"{_CV}, pp AS (SELECT test AS title, list(DISTINCT category) AS p FROM cp GROUP BY test) SELECT title, len(list_intersect(categories, p)) * 2 / len(categories) * len(p) AS score FROM li JOIN pp USING (title)"),
    "title_sanitize": (title_sanitize, r"""SELECT CAST(page_id AS BIGINT) AS page_id, t AS title, regexp_replace(t, '\.[^.]*$', '') AS base
        FROM (SELECT page_id, replace(translate(page_title, '/\ :', '____'), '"', '') AS t FROM page)"""),
    "upsert_last_wins": (upsert_last_wins, r"""SELECT t AS title, md5(coalesce(arg_max_null(text, doc_id), '')) AS body_md5 FROM (SELECT replace(translate(title, '/\ :', '____'), '"', '') AS t, text, doc_id FROM documents) GROUP BY t"""),
    "xml_dump": (xml_dump, "SELECT title, md5(CASE WHEN trim(text) <> '' THEN text ELSE '' END) AS body_md5 FROM documents"),
    "strip_noise": (strip_noise_, f"WITH {_ART}, {_CLEAN} SELECT title, body AS clean FROM cl"),
    "extract_categories": (extract_categories, f"WITH {_ART}, {_CLEAN} SELECT title, CAST(row_number() OVER (PARTITION BY title ORDER BY i) - 1 AS BIGINT) AS position, category FROM (SELECT title, i, {_NAME} AS category FROM (SELECT title, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM (SELECT title, regexp_extract_all(body, '{_q(CATEGORY)}') AS xs FROM cl))) WHERE category <> ''"),
    "tokenize": (tokenize, f"WITH {_ART}, {_CLEAN}, {_TOK} SELECT term, count(*) AS n FROM tok GROUP BY term"),
    "word_count": (word_count, f"{_BASE} SELECT title, term, cnt FROM tf"),
    "lemmatized_word_count": (lemmatized_word_count, f"{_BASE}, {_DICT} SELECT title, coalesce(lexeme, term) AS term, CAST(sum(cnt) AS BIGINT) AS cnt FROM tf LEFT JOIN dict ON form = term WHERE coalesce(lexeme, term) <> '' GROUP BY 1, 2"),
    "article_vectors": (article_vectors, f"{_BASE} SELECT t.title, n_terms, n_tokens, coalesce(len(categories), 0) AS n_categories FROM (SELECT title, count(*) AS n_terms, CAST(sum(cnt) AS BIGINT) AS n_tokens FROM tf GROUP BY title) t LEFT JOIN li ON li.title = t.title"),
    "l2_norms": (l2_norms, f"{_BASE}, {_NORM} SELECT title, CAST(q AS BIGINT) AS q, sqrt(q::DOUBLE) AS norm FROM nm"),
    "cosine_to_query": (cosine_to_query, f"{_BASE}, {_NORM}, {_QUERY}, {_SIM} SELECT q.title AS query, li.title, round(coalesce(sim.similarity, 0), 12) AS similarity FROM (SELECT DISTINCT title FROM qt) q CROSS JOIN li LEFT JOIN sim ON sim.title = li.title AND sim.query = q.title"),
    "categorized_only": (categorized_only, f"{_BASE} SELECT title, CAST(sum(cnt) AS BIGINT) AS n_tokens FROM tf WHERE title IN (SELECT title FROM li) GROUP BY title"),
    "knn_top_k": (knn_top_k, f"{_BASE}, {_NORM}, {_QUERY}, {_SIM}, {_KNN} SELECT query, title, round(similarity, 12) AS similarity, rank FROM nn"),
    "vote_and_cut": (vote_and_cut, f"{_BASE}, {_NORM}, {_QUERY}, {_SIM}, {_KNN} SELECT query, category, votes FROM (SELECT *, max(votes) OVER (PARTITION BY query) AS most FROM (SELECT query, category, round(sum(similarity), 9) AS votes FROM (SELECT query, similarity, unnest(categories) AS category FROM nn) GROUP BY ALL)) WHERE round(votes / most, 9) >= 1.0"),
    "assign_folds": (assign_folds, f"WITH {_ART}, {_FOLD} SELECT title, fold FROM fo"),
    "fold_sizes": (fold_sizes, f"WITH {_ART}, {_FOLD} SELECT fold, count(*) AS n FROM fo GROUP BY fold"),
    "fold_pruned_counts": (fold_pruned_counts, f"WITH {_ART}, {_FOLD} SELECT fold, count(*) AS test, (SELECT count(*) FROM fo) - count(*) AS train FROM fo GROUP BY fold"),
    "cv_pairs": (cv_pairs, f"{_BASE}, {_NORM}, {_FOLD}, {_PAIRS} SELECT fold, test, train, round(similarity, 12) AS similarity FROM pr"),
    "cv_predict": (cv_predict, f"{_CV} SELECT test, category, votes FROM cp"),
    "cv_scores": (cv_scores, f"{_CV}, {_SCORE} SELECT title, tp, fp, fn, sensitivity, precision, f_measure FROM sc"),
    "cv_average": (cv_average, f"{_CV}, {_SCORE} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(sensitivity), 9) AS sensitivity, round(avg(precision), 9) AS precision, round(avg(f_measure), 9) AS f_measure FROM sc HAVING count(*) > 0"),
    "category_page_view": (category_page_view, "SELECT cl_to, page_title, count(*) AS n FROM categorylinks JOIN page ON cl_from = page_id GROUP BY ALL"),
    "top3_categories": (top3_categories, f"{_BASE} SELECT category, count(*) AS n FROM cats GROUP BY category ORDER BY n DESC, category LIMIT 3"),
    "matrix_rows": (matrix_rows, "SELECT CAST(l_orderkey AS INT) AS article_id, CAST(l_linenumber AS INT) AS word_id, CAST(trunc(l_quantity) AS INT) AS cnt FROM lineitem"),
    "dictionary_words": (dictionary_words, "SELECT DISTINCT lower(form) AS word FROM dictionary WHERE form IS NOT NULL"),
}
