"""Queries over the wiki link tables: problems 3, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.titles import canonical_sql, canonical_title
from ..operators.hierarchy import Hierarchy, hierarchy
from ..operators.hot_keys import Merge, tree_aggregate
from ..operators.references import key_states, unresolved_references
from ..session import cut, load, skew_join

#: Fixed value: the namespace of category pages.
CATEGORY_NAMESPACE = 14


def category_hierarchy(spark: SparkSession, sf_dir: str, **how: bool) -> Hierarchy:
    page = load(spark, sf_dir, "page").filter(F.col("page_namespace") == CATEGORY_NAMESPACE)
    nodes = page.select(F.col("page_id").cast("bigint").alias("id"), canonical_title(F.col("page_title")).alias("title"))
    titles = nodes.filter("title <> ''").groupBy("title").agg(F.min("id").alias("parent"))
    sub = load(spark, sf_dir, "categorylinks").filter(F.lower(F.trim("cl_type")) == "subcat")
    edges = cut(sub.select(F.col("cl_from").cast("bigint").alias("child"), canonical_title(F.col("cl_to")).alias("title")).distinct(), "subcats")
    return hierarchy(nodes, skew_join(edges, cut(titles, "titles"), ["title"], "inner"), **how)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = category_hierarchy(spark, sf_dir, with_path=False).nodes
    return nodes.select(F.col("id").alias("page_id"), F.col("root").alias("root_id"), "depth")


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = category_hierarchy(spark, sf_dir).nodes
    return nodes.select(
        F.col("id").alias("page_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth",
        F.concat_ws("/", "path").alias("path"), "subtree_size", "height",
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_hierarchy(spark, sf_dir, with_path=False, with_descendants=True).descendants


_P3_TREE = f"""
WITH RECURSIVE n AS (SELECT DISTINCT CAST(page_id AS BIGINT) id, {canonical_sql('page_title')} title FROM page WHERE page_namespace = 14),
e AS (SELECT CAST(cl_from AS BIGINT) child, min(n.id) parent FROM categorylinks JOIN n ON {canonical_sql('cl_to')} = n.title
      WHERE lower(trim(cl_type)) = 'subcat' AND CAST(cl_from AS BIGINT) IN (SELECT id FROM n) GROUP BY 1),
t AS (SELECT n.id, NULL::BIGINT parent, n.id root, 0::BIGINT depth, CAST(n.id AS VARCHAR) path FROM n WHERE n.id NOT IN (SELECT child FROM e)
      UNION ALL SELECT e.child, e.parent, t.root, t.depth + 1, t.path || '/' || e.child FROM t JOIN e ON e.parent = t.id),
w(id, spot, step) AS (SELECT id, id, 0 FROM n WHERE id NOT IN (SELECT id FROM t)
      UNION ALL SELECT w.id, e.parent, step + 1 FROM w JOIN e ON e.child = w.spot WHERE step < (SELECT count(*) FROM e WHERE child NOT IN (SELECT id FROM t))),
c AS (SELECT DISTINCT id FROM w WHERE spot = id AND step > 0),
b AS (SELECT w.id, min(w.spot) root, CASE WHEN w.id IN (SELECT id FROM c) THEN -1 ELSE -2 END::BIGINT depth FROM w WHERE w.spot IN (SELECT id FROM c) GROUP BY w.id)
"""
P3_FOUND_SQL = _P3_TREE + """SELECT id AS page_id, root AS root_id, depth FROM t UNION ALL SELECT id, root, depth FROM b"""
P3_HIERARCHY_SQL = _P3_TREE + """,
d(top, id, k) AS (SELECT n.id, n.id, 0 FROM n UNION ALL SELECT d.top, e.child, k + 1 FROM d JOIN e ON e.parent = d.id WHERE e.child NOT IN (SELECT id FROM c)),
s AS (SELECT top, count(*) AS subtree_size, max(k) AS height FROM d GROUP BY top)
SELECT a.id AS page_id, e.parent AS parent_id, a.root AS root_id, a.depth, coalesce(a.path, '') AS path, s.subtree_size, CAST(s.height AS BIGINT) AS height
FROM (SELECT id, root, depth, path FROM t UNION ALL SELECT id, root, depth, NULL FROM b) a LEFT JOIN e ON e.child = a.id JOIN s ON s.top = a.id"""
P3_DESCENDANTS_SQL = _P3_TREE + """,
d(top, id, k) AS (SELECT n.id, n.id, 0 FROM n UNION ALL SELECT d.top, e.child, k + 1 FROM d JOIN e ON e.parent = d.id WHERE e.child NOT IN (SELECT id FROM c))
SELECT top AS ancestor, id AS descendant, k AS distance FROM d WHERE k > 0"""


def page_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, namespace, title, load_ts) of the pages, and (.., deleted_ts, restored_ts) of their deletions."""
    page, gone = load(spark, sf_dir, "page"), load(spark, sf_dir, "page_deletions")
    key = [F.col("page_id").cast("bigint").alias("page_id"), F.col("page_namespace").cast("int").alias("namespace"), canonical_title(F.col("page_title")).alias("title")]
    return page.select(*key, F.col("load_ts").cast("timestamp_ntz").alias("load_ts")), gone.select(*key, "deleted_ts", "restored_ts")


def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cl_id, ref_field, reason, period) of the link references that lead nowhere; one link may give two."""
    pages, deletions = page_records(spark, sf_dir)
    links = load(spark, sf_dir, "categorylinks")
    # one scan for both fields, in which each title is made canonical once
    refs = cut(links.select(
        F.col("cl_id").cast("bigint").alias("cl_id"), F.coalesce(F.date_format("cl_timestamp", "yyyy-MM"), F.lit("unknown")).alias("period"),
        F.col("load_ts").cast("timestamp_ntz").alias("load_ts"), F.nullif(F.col("cl_from").cast("bigint"), F.lit(0).cast("bigint")).alias("page_id"),
        F.lit(CATEGORY_NAMESPACE).alias("namespace"), F.nullif(canonical_title(F.col("cl_to")), F.lit("")).alias("title"),
    ), "references")
    by_id = unresolved_references(
        refs.select("cl_id", "period", "load_ts", "page_id"),
        key_states(pages.withColumn("record", F.col("page_id")), deletions.withColumn("record", F.col("page_id")), ["page_id"], "record"),
        ["page_id"], "load_ts",
    )
    by_title = unresolved_references(
        refs.select("cl_id", "period", "load_ts", "namespace", "title"),
        key_states(pages, deletions, ["namespace", "title"], "page_id"), ["namespace", "title"], "load_ts",
    )
    out = lambda df, field: df.select("cl_id", F.lit(field).alias("ref_field"), "reason", "period")
    return out(by_id, "cl_from").unionByName(out(by_title, "cl_to"))


#: The namespace that a link's type says its page has.
TYPE_NAMESPACE = {"page": 0, "subcat": 14, "file": 6}


def typed_links(spark: SparkSession, sf_dir: str, match: str) -> DataFrame:
    """(cl_id, reason) of the links whose page, by id and by the namespace of the link's type, does not exist. Either column may be null."""
    pages, deletions = page_records(spark, sf_dir)
    kind = F.lower(F.trim("cl_type"))
    space = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in TYPE_NAMESPACE.items()])
    refs = load(spark, sf_dir, "categorylinks").select(
        F.col("cl_id").cast("bigint").alias("cl_id"), F.nullif(F.col("cl_from").cast("bigint"), F.lit(0).cast("bigint")).alias("page_id"), space.alias("namespace"),
        F.col("load_ts").cast("timestamp_ntz").alias("load_ts"),
    )
    by = lambda d: d.withColumn("record", F.col("page_id"))
    states = key_states(by(pages), by(deletions), ["page_id", "namespace"], "record")
    return unresolved_references(cut(refs, "references"), cut(states, "states"), ["page_id", "namespace"], "load_ts", match).select("cl_id", "reason")


def p4_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_links(spark, sf_dir, "simple")


def p4_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_links(spark, sf_dir, "partial")


def p4_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_links(spark, sf_dir, "full")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unresolved_links(spark, sf_dir).distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unresolved_links(spark, sf_dir).groupBy("ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


P4_FOUND_SQL = f"""
WITH g AS (SELECT page_id, min(page_namespace) ns, min({canonical_sql('page_title')}) title, max_by(restored_ts IS NULL, (deleted_ts, restored_ts IS NULL)) gone FROM page_deletions GROUP BY page_id),
p AS (SELECT page_id, page_namespace ns, {canonical_sql('page_title')} title, min(load_ts) seen FROM page GROUP BY ALL),
k AS (SELECT coalesce(p.page_id, g.page_id) id, coalesce(p.ns, g.ns) ns, coalesce(p.title, g.title) title, seen, p.page_id IS NOT NULL present, coalesce(gone, false) gone
      FROM p FULL JOIN g ON p.page_id = g.page_id),
l AS (SELECT cl_id, 'cl_from' ref_field, k.*, c.cl_timestamp, c.load_ts FROM categorylinks c LEFT JOIN k ON k.id = c.cl_from WHERE c.cl_from <> 0
      UNION ALL SELECT cl_id, 'cl_to', k.*, c.cl_timestamp, c.load_ts FROM (SELECT *, {canonical_sql('cl_to')} t FROM categorylinks) c LEFT JOIN k ON k.ns = 14 AND k.title = c.t WHERE c.t <> '')
SELECT DISTINCT CAST(cl_id AS BIGINT) AS cl_id, ref_field, CASE WHEN gone THEN 'deleted' WHEN present IS NOT TRUE THEN 'missing' ELSE 'late' END AS reason,
       coalesce(strftime(cl_timestamp, '%Y-%m'), 'unknown') AS period
FROM l WHERE gone OR present IS NOT TRUE OR seen > load_ts"""
P4_REPORT_SQL = f"SELECT ref_field, period, reason, count(*) AS n FROM ({P4_FOUND_SQL}) GROUP BY ALL"


_P4_TYPED = """
WITH g AS (SELECT page_id, page_namespace ns, max_by(restored_ts IS NULL, (deleted_ts, restored_ts IS NULL)) gone FROM page_deletions GROUP BY ALL),
p AS (SELECT page_id, page_namespace ns, min(load_ts) seen FROM page GROUP BY ALL),
k AS (SELECT coalesce(p.page_id, g.page_id) id, coalesce(p.ns, g.ns) ns, seen, p.page_id IS NOT NULL present, coalesce(gone, false) gone FROM p FULL JOIN g ON p.page_id = g.page_id AND p.ns = g.ns),
r AS (SELECT cl_id, nullif(cl_from, 0) id, CASE lower(trim(cl_type)) WHEN 'page' THEN 0 WHEN 'subcat' THEN 14 WHEN 'file' THEN 6 END ns, load_ts FROM categorylinks),
kb AS (SELECT id, ns, bool_or(present) present, bool_and(gone) gone, min(seen) seen FROM k GROUP BY ALL),
ki AS (SELECT id, bool_or(present) present, bool_and(gone) gone, min(seen) seen FROM k GROUP BY ALL),
kn AS (SELECT ns, bool_or(present) present, bool_and(gone) gone, min(seen) seen FROM k GROUP BY ALL),
both_ AS (SELECT r.*, present, gone, seen FROM r LEFT JOIN kb USING (id, ns) WHERE r.id IS NOT NULL AND r.ns IS NOT NULL),
part AS (SELECT r.*, present, gone, seen FROM r LEFT JOIN ki USING (id) WHERE r.id IS NOT NULL AND r.ns IS NULL
         UNION ALL SELECT r.*, present, gone, seen FROM r LEFT JOIN kn USING (ns) WHERE r.id IS NULL AND r.ns IS NOT NULL)
"""
_P4_CASE = "SELECT CAST(cl_id AS BIGINT) AS cl_id, CASE WHEN gone THEN 'deleted' WHEN present IS NOT TRUE THEN 'missing' ELSE 'late' END AS reason FROM {} WHERE gone OR present IS NOT TRUE OR seen > load_ts"
P4_SIMPLE_SQL = _P4_TYPED + _P4_CASE.format("both_")
P4_PARTIAL_SQL = _P4_TYPED + _P4_CASE.format("(SELECT * FROM both_ UNION ALL SELECT * FROM part)")
P4_FULL_SQL = P4_SIMPLE_SQL + " UNION ALL SELECT CAST(cl_id AS BIGINT), 'partial_null' FROM part"


def category_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per canonical category: links, distinct members, first and last link."""
    links = load(spark, sf_dir, "categorylinks").select(
        F.nullif(canonical_title(F.col("cl_to")), F.lit("")).alias("cl_to"), F.col("cl_id").cast("bigint").alias("cl_id"),
        F.nullif(F.col("cl_from").cast("bigint"), F.lit(0).cast("bigint")).alias("member"), "cl_timestamp",
    ).filter("cl_to is not null")
    at = F.when(F.col("cl_timestamp").isNotNull(), F.struct("cl_timestamp", "cl_id"))
    # one row per category and member, with the links between them: this spreads a hot category over all tasks
    pairs = links.groupBy("cl_to", "member").agg(F.count(F.lit(1)).alias("links"), F.min(at).alias("first"), F.max(at).alias("last"))
    return tree_aggregate(
        pairs, ["cl_to"],
        [Merge("n_links", F.col("links")), Merge("n_members", F.col("member").isNotNull().cast("bigint")),
         Merge("first", F.col("first"), "min"), Merge("last", F.col("last"), "max")],
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = load(spark, sf_dir, "categorylinks")
    counts = tree_aggregate(
        links.select(canonical_title(F.col("cl_to")).alias("cl_to")), ["cl_to"], [Merge("n", F.lit(1).cast("bigint"))]
    )
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.filter("cl_to <> ''").join(F.broadcast(total), F.col("n") * 100 >= F.col("total")).select("cl_to")


def p5_category_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_members(spark, sf_dir).select(
        "cl_to", "n_links", "n_members", F.col("first.cl_id").alias("first_cl_id"), F.col("first.cl_timestamp").alias("first_ts"),
        F.col("last.cl_id").alias("last_cl_id"), F.col("last.cl_timestamp").alias("last_ts"),
    )


P5_FOUND_SQL = f"""SELECT {canonical_sql('cl_to')} AS cl_to FROM categorylinks WHERE {canonical_sql('cl_to')} <> '' GROUP BY 1
HAVING count(*) * 100 >= (SELECT count(*) FROM categorylinks)"""
P5_MEMBERS_SQL = f"""SELECT {canonical_sql('cl_to')} AS cl_to, count(*) AS n_links, count(DISTINCT CASE WHEN cl_from <> 0 THEN cl_from END) AS n_members,
CAST(arg_min(cl_id, (cl_timestamp, cl_id)) FILTER (cl_timestamp IS NOT NULL) AS BIGINT) AS first_cl_id, min(cl_timestamp) AS first_ts,
CAST(arg_max(cl_id, (cl_timestamp, cl_id)) FILTER (cl_timestamp IS NOT NULL) AS BIGINT) AS last_cl_id, max(cl_timestamp) AS last_ts
FROM categorylinks WHERE {canonical_sql('cl_to')} <> '' GROUP BY 1"""

QUERIES = {
    "p3_found": (p3_found, P3_FOUND_SQL),
    "p3_hierarchy": (p3_hierarchy, P3_HIERARCHY_SQL),
    "p3_descendants": (p3_descendants, P3_DESCENDANTS_SQL),
    "p4_found": (p4_found, P4_FOUND_SQL),
    "p4_report": (p4_report, P4_REPORT_SQL),
    "p4_simple": (p4_simple, P4_SIMPLE_SQL),
    "p4_partial": (p4_partial, P4_PARTIAL_SQL),
    "p4_full": (p4_full, P4_FULL_SQL),
    "p5_found": (p5_found, P5_FOUND_SQL),
    "p5_category_members": (p5_category_members, P5_MEMBERS_SQL),
}
