"""Registered queries: the operators applied to whole tables, each with the same result in SQL.

The tables stand in for a graph: regions and nations are directories, customers and suppliers files,
orders classes; an order depends on the suppliers of its items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ident
from graphloom.functions.scratch import written
from graphloom.operators import describe, extract, graph, notes, pruned, reconcile, search
from graphloom.operators.resolve import Resolver
from graphloom.plans import sample
from graphloom.sources.tree import directories
from graphloom.streaming.upsert import upserted

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (id, parent_id, type, name, uid) of the containment tree over the tables."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda i, p, kind, name: (i.alias("id"), p.alias("parent_id"), F.lit(kind).alias("type"), name.alias("name"), i.alias("uid"))
    label = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    parts = [
        t("region").select(*node(label("R", "r_regionkey"), F.lit(None).cast("string"), "directory", F.col("r_name"))),
        t("nation").select(*node(label("N", "n_nationkey"), label("R", "n_regionkey"), "directory", F.col("n_name"))),
        t("customer").select(*node(label("C", "c_custkey"), label("N", "c_nationkey"), "file", F.col("c_name"))),
        t("supplier").select(*node(label("S", "s_suppkey"), label("N", "s_nationkey"), "file", F.col("s_name"))),
        t("orders").select(*node(label("O", "o_orderkey"), label("C", "o_custkey"), "class", F.col("o_orderpriority"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order depends on its items' suppliers."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target_id")).distinct()


TREE_SQL = """
tree(id, parent_id, type, name) AS (
  SELECT 'R' || r_regionkey, NULL::VARCHAR, 'directory', r_name FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'directory', n_name FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'file', c_name FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'file', s_name FROM supplier
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, 'class', o_orderpriority FROM orders
)"""
EDGES_SQL = "dep(source_id, target_id) AS (SELECT DISTINCT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem)"
LIFT_SQL = f"""
WITH RECURSIVE {TREE_SQL}, {EDGES_SQL}, up(source_id, target_id) AS (
  SELECT * FROM dep UNION
  SELECT s.parent_id, t.parent_id FROM up JOIN tree s ON s.id = source_id JOIN tree t ON t.id = target_id
  WHERE s.parent_id IS NOT NULL AND t.parent_id IS NOT NULL AND s.parent_id <> t.parent_id
)"""

_KNN = """
SELECT query_id, id, round(distance, 6) AS distance, nth FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id)::INTEGER AS nth
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id {also}
) WHERE nth <= 5"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(_KNN.format(also=""))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to each query (every id divisible by 20) among all rows."""
    rows = _vectors(spark, sf_dir)
    return search.knn_join(rows.where("id % 20 = 0"), rows).withColumn("distance", F.round("distance", 6))


@query(_KNN.format(also=""))
def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn_topk, without the cells that cannot hold a nearer row."""
    rows = _vectors(spark, sf_dir)
    return pruned.knn_pruned(rows.where("id % 20 = 0"), rows)[0].withColumn("distance", F.round("distance", 6))


@query(_KNN.format(also="AND v.label = 3"))
def knn_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn_topk among the rows of one type: filtered before the search, so never fewer than there are."""
    rows = _vectors(spark, sf_dir)
    return search.knn_join(rows.where("id % 20 = 0"), rows.where("label = 3")).withColumn("distance", F.round("distance", 6))


@query("""
WITH m AS (SELECT label, i::INTEGER - 1 AS i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2),
n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1)
SELECT label, i::INTEGER AS i, round(CASE WHEN norm > 1e-9 THEN m / norm ELSE m END, 6) AS value FROM m JOIN n USING (label)""")
def centroid_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.mean_by(_vectors(spark, sf_dir), "label").withColumn("value", F.round("value", 6))


@query("""
WITH leaf AS (SELECT 'L' || label AS id, embedding::DOUBLE[] AS v FROM embeddings),
up AS (SELECT DISTINCT 'L' || label AS id, a AS anc FROM embeddings, (VALUES (0), (1), (2)) l(k), LATERAL (SELECT CASE k WHEN 0 THEN 'L' || label WHEN 1 THEN 'G' || (label % 3) ELSE 'root' END AS a)),
m AS (SELECT anc AS id, i::INTEGER - 1 AS i, avg(x) AS m FROM (SELECT anc, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM leaf JOIN up USING (id)) GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1)
SELECT id, i::INTEGER AS i, round(CASE WHEN norm > 1e-9 THEN m / norm ELSE m END, 6) AS value FROM m JOIN n USING (id)""")
def subtree_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of every label, of groups of labels, and of the root above them."""
    rows = _vectors(spark, sf_dir)
    labels = rows.select("label").distinct()
    leaf, group = F.concat(F.lit("L"), F.col("label").cast("string")), F.concat(F.lit("G"), (F.col("label") % 3).cast("string"))
    nodes = labels.select(leaf.alias("id"), group.alias("parent_id")).unionByName(labels.select(group.alias("id"), F.lit("root").alias("parent_id")).distinct())
    nodes = nodes.unionByName(labels.limit(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent_id")))
    return search.subtree_centroids(nodes, rows.select(leaf.alias("id"), "vector")).withColumn("value", F.round("value", 6))


@query("SELECT event_type AS type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("type")))


@query(f"WITH RECURSIVE {TREE_SQL}, {EDGES_SQL} SELECT type, count(*)::BIGINT AS n FROM tree GROUP BY type UNION ALL SELECT 'edges', count(*)::BIGINT FROM dep UNION ALL SELECT 'notes', count(*)::BIGINT FROM conversations")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type, and how many edges and notes there are."""
    return graph.status_counts(tree(spark, sf_dir), edges(spark, sf_dir), table(spark, sf_dir, "conversations"))


@query("SELECT page_id, url, starts_with(url, 'https://') AS secure FROM pages WHERE starts_with(url, 'https://blog.tionsh.example.net/') OR url = 'https://blog.tionsh.example.net'")
def subtree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths at or below a prefix, compared as it stands: the filter reaches the scan."""
    rows = table(spark, sf_dir, "pages")
    return rows.where(ident.in_subtree(F.col("url"), "https://blog.tionsh.example.net")).select("page_id", "url", F.col("url").startswith("https://").alias("secure"))


@query("""
WITH c AS (SELECT page_id, regexp_replace(url, '^.*?//[^/]*/', '') AS candidate FROM pages)
SELECT c.page_id, p.page_id AS target_id FROM c JOIN pages p ON p.url = candidate OR ends_with(p.url, '/' || candidate)""")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import candidates (a page's path) against all uids that are it or end with it."""
    pages = table(spark, sf_dir, "pages")
    wanted = pages.select("page_id", F.regexp_replace("url", "^.*?//[^/]*/", "").alias("candidate"))
    found = graph.suffix_matches(wanted, pages.select(F.col("url").alias("uid")))
    return wanted.join(found, "candidate").join(pages.select(F.col("page_id").alias("target_id"), F.col("url").alias("uid")), "uid").select("page_id", "target_id")


@query("SELECT page_id, regexp_replace(url, '^[^#]*#', '#') AS short_uid, split_part(url, '#', 1) AS file_uid, split_part(url, '/', -1) AS suffix_key FROM pages")
def short_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", ident.short_uid(url).alias("short_uid"), ident.file_uid(url).alias("file_uid"), ident.suffix_key(url).alias("suffix_key"))


@query("SELECT page_id, 'F-' || substr(md5(url), 1, 10) AS id FROM pages")
def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ident.node_id(F.lit("file"), F.col("url")).alias("id"))


@query("SELECT doc_id, md5(text) AS diff_hash FROM documents")
def diff_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ident.diff_hash(F.col("text")).alias("diff_hash"))


@query("SELECT page_id, 'F-' || substr(md5(url), 1, 10) AS id, md5(html) AS diff_hash, 1::INTEGER AS start_line, (len(string_split(html, chr(10))) - CASE WHEN ends_with(html, chr(10)) THEN 1 ELSE 0 END)::INTEGER AS end_line, length(html)::INTEGER AS length FROM pages")
def html_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file node of each HTML page: identity, hash and line bounds."""
    pages = table(spark, sf_dir, "pages")
    nodes = extract.html_nodes(pages.select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content")))
    nodes = nodes.select(F.col("uid").alias("url"), ident.node_id(F.col("type"), F.col("uid")).alias("id"), "diff_hash", "start_line", "end_line", F.length("body").alias("length")).distinct()
    return pages.select("page_id", "url", F.md5("html").alias("diff_hash")).join(nodes, ["url", "diff_hash"]).drop("url")


@query(f"""
WITH RECURSIVE {TREE_SQL}, up(ancestor_id, id, depth) AS (
  SELECT id, id, 0 FROM tree UNION ALL SELECT t.parent_id, up.id, depth + 1 FROM up JOIN tree t ON t.id = ancestor_id WHERE t.parent_id IS NOT NULL)
SELECT ancestor_id, id, depth::INTEGER AS depth FROM up""")
def containment_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(tree(spark, sf_dir))


@query(f"""
WITH RECURSIVE {TREE_SQL}, s(root_id, id, type, depth, path) AS (
  SELECT id, id, type, 0, id FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT s.root_id, t.id, t.type, depth + 1, path || ' / ' || CASE t.type WHEN 'file' THEN '1:' WHEN 'directory' THEN '2:' ELSE '3:' END || t.id
  FROM s JOIN tree t ON t.parent_id = s.id WHERE s.type <> 'class' AND depth < 3)
SELECT root_id, id, type, depth::INTEGER AS depth, path FROM s""")
def skeleton_depth_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree three levels deep below every root, with the path that sorts it."""
    return graph.skeleton(tree(spark, sf_dir), F.col("parent_id").isNull(), 3).select("root_id", "id", "type", "depth", F.array_join("sort_path", " / ").alias("path"))


@query(f"""
WITH RECURSIVE {TREE_SQL}, s(root_id, id, type, depth) AS (
  SELECT id, id, type, 0 FROM tree WHERE type = 'file'
  UNION ALL SELECT s.root_id, t.id, t.type, depth + 1 FROM s JOIN tree t ON t.parent_id = s.id WHERE depth < 2)
SELECT root_id, id, type, depth::INTEGER AS depth FROM s""")
def inspect_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an inspection of every file shows."""
    return graph.inspect_children(tree(spark, sf_dir), F.col("type") == "file")


@query(f"{LIFT_SQL} SELECT source_id, target_id FROM up WHERE source_id <> target_id")
def edges_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dependencies of orders on suppliers and what they imply above them."""
    return graph.lift_edges(edges(spark, sf_dir), tree(spark, sf_dir))


@query(f"""
WITH RECURSIVE {TREE_SQL}, pairs AS (SELECT 'O' || l_orderkey AS s, 'S' || l_suppkey AS t, min(l_linenumber) <= 3 AS first, any_value(l_orderkey) AS k FROM lineitem GROUP BY 1, 2),
chain(s, t) AS (
  SELECT s, t FROM pairs WHERE NOT (first AND k % 7 = 0)
  UNION ALL SELECT a.parent_id, b.parent_id FROM chain JOIN tree a ON a.id = s JOIN tree b ON b.id = t WHERE a.parent_id <> b.parent_id)
SELECT s AS source_id, t AS target_id, count(*)::BIGINT AS n FROM chain GROUP BY 1, 2""")
def edges_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifted dependencies kept up to date: from those of each order's first items every seventh order's go, the others' later items come."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg((F.min("l_linenumber") <= 3).alias("first"))
    line = line.select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target_id"), "first", (F.col("l_orderkey") % 7 == 0).alias("gone"))
    line, paths = written(line, "pairs"), graph.root_paths(tree(spark, sf_dir))
    counts = written(graph.lift_counts(line.where("first"), paths), "counts")
    return graph.lift_change(counts, line.where("first and gone"), line.where("not first"), paths)


@query(f"""
WITH RECURSIVE {TREE_SQL}, {EDGES_SQL}
SELECT source_id AS id, string_agg(target_id || '|' || target_id, ',' ORDER BY target_id || '|' || target_id) AS dependencies FROM dep GROUP BY 1""")
def dependency_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.dependency_strings(edges(spark, sf_dir).withColumn("edge_type", F.lit("depends_on")), tree(spark, sf_dir))
    return out.select("id", F.array_join("dependencies", ",").alias("dependencies"))


@query(f"""
WITH RECURSIVE {TREE_SQL}, {EDGES_SQL}
SELECT id, (coalesce(i.n, 0) + coalesce(k.n, 0))::BIGINT AS impact FROM tree
LEFT JOIN (SELECT target_id AS id, count(*) AS n FROM dep GROUP BY 1) i USING (id)
LEFT JOIN (SELECT parent_id AS id, count(DISTINCT type) AS n FROM tree WHERE parent_id IS NOT NULL GROUP BY 1) k USING (id)""")
def impact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact_score(edges(spark, sf_dir).withColumn("edge_type", F.lit("depends_on")), tree(spark, sf_dir))


_DOCS_OLD = "SELECT doc_id::VARCHAR AS uid, CASE WHEN n_chars % 2 = 0 THEN md5(text) ELSE md5(text || '!') END AS diff_hash, source || ':' || lang AS description FROM documents"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as parsed now, and as an earlier version in which texts of odd length were others."""
    docs = table(spark, sf_dir, "documents")
    uid = F.col("doc_id").cast("string").alias("uid")
    old = F.when(F.col("n_chars") % 2 == 0, F.md5("text")).otherwise(F.md5(F.concat("text", F.lit("!"))))
    return docs.select(uid, F.md5("text").alias("diff_hash"), F.lit("").alias("description")), docs.select(uid, old.alias("diff_hash"), F.concat_ws(":", "source", "lang").alias("description"))


@query(f"WITH old AS ({_DOCS_OLD}) SELECT d.doc_id::VARCHAR AS uid, md5(d.text) AS diff_hash, old.description FROM documents d LEFT JOIN old ON old.uid = d.doc_id::VARCHAR AND old.diff_hash = md5(d.text)")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions carried from the previous version where the content is the same."""
    return reconcile.carry_over(*_versions(spark, sf_dir))


@query("SELECT doc_id, md5(text) AS diff_hash, coalesce('quality ' || quality, '') AS description FROM documents LEFT JOIN labels USING (doc_id)")
def lockfile_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty descriptions filled from entries of the same content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("uid"), F.md5("text").alias("diff_hash"), F.lit("").alias("description"))
    lock = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("uid", "diff_hash", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("description"))
    return reconcile.seed(docs, lock).select("doc_id", "diff_hash", F.coalesce("description", F.lit("")).alias("description"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def prune_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.prune(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"""
WITH RECURSIVE {TREE_SQL}, {EDGES_SQL}, gone AS (SELECT 'O' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')
SELECT 'structs' AS part, count(*)::BIGINT AS n FROM tree WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'edges', count(*)::BIGINT FROM dep WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'vectors', count(*)::BIGINT FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'notes', count(*)::BIGINT FROM orders WHERE o_orderstatus <> 'F'""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each table after the finished orders are deleted with all that hangs on them."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderstatus")
    left = reconcile.cascade_delete(orders.where("o_orderstatus = 'F'"), tree(spark, sf_dir), edges(spark, sf_dir), orders.select("id"), orders.select(F.col("id").alias("struct_id")))
    counts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in zip(("structs", "edges", "vectors", "notes"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT user_id, min(ts) AS date_added, max(ts) AS date_last_updated, count(*)::BIGINT AS versions FROM events GROUP BY 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("date_added"))
    now = events.groupBy("user_id").agg(F.max("date_added").alias("date_added"), F.count("*").alias("versions")).withColumn("date_last_updated", F.col("date_added"))
    return reconcile.first_seen(now, events, "user_id")


@query("SELECT doc_id, CASE WHEN source <> '' THEN '[STALE] ' || source ELSE source END AS description, CASE WHEN source <> '' THEN source ELSE '' END AS plain FROM documents")
def stale_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", ident.staled(F.col("source")).alias("description"))
    return docs.withColumn("plain", ident.unstaled(F.col("description")))


_NOTES = "SELECT conv_id * 1000 + turn AS note_id, conv_id AS struct_id, text AS content, role AS author, lpad(turn::VARCHAR, 4, '0') AS date_added FROM conversations"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.col("conv_id").alias("struct_id"), F.col("text").alias("content"), F.col("role").alias("author"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("date_added"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("date_last_updated"))


@query(f"SELECT note_id, struct_id, content, author, date_added FROM ({_NOTES}) QUALIFY row_number() OVER (PARTITION BY struct_id ORDER BY note_id DESC) <= 3")
def note_ring_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three notes of each node."""
    return graph.ring(_notes(spark, sf_dir), "struct_id", "note_id", 3).drop("date_last_updated")


@query(f"SELECT struct_id::VARCHAR AS uid, string_agg(author || '@' || date_added || ':' || md5(content), ',' ORDER BY note_id) AS notes FROM ({_NOTES}) GROUP BY 1")
def notes_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's notes in order, by uid and without ids."""
    rows = _notes(spark, sf_dir)
    out = notes.export(rows, rows.select(F.col("struct_id").alias("id"), F.col("struct_id").cast("string").alias("uid")).distinct())
    return out.select("uid", F.array_join(F.transform("notes", lambda n: F.concat(n["author"], F.lit("@"), n["date_added"], F.lit(":"), F.md5(n["content"]))), ",").alias("notes"))


@query("""
WITH e AS (SELECT user_id AS struct_id, event_type AS author, event_id, ts, value FROM events)
SELECT struct_id, author, arg_max(event_id, (ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END, event_id)) AS note_id, max(ts) AS date_last_updated FROM e GROUP BY 1, 2""")
def notes_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides with edits of the same notes, merged: the last writer wins, the local side wins ties."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("struct_id"), F.col("event_type").alias("author"), F.col("event_id").alias("note_id"), F.col("ts").alias("date_last_updated"))
    return notes.merge(rows.where("note_id % 2 = 0"), rows.where("note_id % 2 = 1"), keys=("struct_id", "author")).select("struct_id", "author", "note_id", "date_last_updated")


@query("SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event that supersedes all others of its key."""
    return reconcile.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


@query("""
WITH c AS (
  SELECT a.p_partkey AS ref, 0 AS rank, b.p_partkey AS target FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND a.p_size = b.p_size
  UNION ALL SELECT p_partkey, 1, t FROM part JOIN (SELECT p_brand, p_size, min(p_partkey) AS t FROM part GROUP BY 1, 2) USING (p_brand, p_size)
  UNION ALL SELECT p_partkey, 2, t FROM part JOIN (SELECT p_name, min(p_partkey) AS t FROM part GROUP BY 1) USING (p_name))
SELECT ref, rank::INTEGER AS rank, target FROM c QUALIFY row_number() OVER (PARTITION BY ref ORDER BY rank, target) = 1""")
def priority_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade of rules as a union of tagged joins: the first hit of each reference stands."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), "p_name", "p_brand", "p_size")
    # of the parts alike in all three only the two smallest can be the first hit of another
    alike = part.groupBy("p_name", "p_brand", "p_size").agg(F.slice(F.array_sort(F.array_agg("ref")), 1, 2).alias("firsts"))
    exact = part.join(alike, ["p_name", "p_brand", "p_size"]).withColumn("target", F.get(F.filter("firsts", lambda x: x != F.col("ref")), 0)).where("target is not null")
    brand = part.join(part.groupBy("p_brand", "p_size").agg(F.min("ref").alias("target")), ["p_brand", "p_size"])
    name = part.join(part.groupBy("p_name").agg(F.min("ref").alias("target")), "p_name")
    tagged = [df.select("ref", F.lit(rank).alias("rank"), "target") for rank, df in enumerate((exact, brand, name))]
    return graph.first_by(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]), ["ref"], "rank", "target")


@query("SELECT text AS name, min(doc_id) AS uid FROM documents GROUP BY 1 HAVING count(*) = 1")
def unique_name_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unique_names(table(spark, sf_dir, "documents"), "text", "doc_id").select(F.col("text").alias("name"), F.col("doc_id").alias("uid"))


@query("SELECT doc_id, doc_id || ': ' || coalesce(nullif(CASE WHEN n_chars < 200 THEN '' ELSE source END, ''), nullif(text, ''), lang) AS text FROM documents")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text to embed: the description if there is one, else the body."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("uid"), F.when(F.col("n_chars") < 200, "").otherwise(F.col("source")).alias("description"), F.col("text").alias("body"), F.lit("").alias("signature"), F.col("lang").alias("name"))
    return rows.select("doc_id", describe.embedding_text().alias("text"))


@query("SELECT e.event_id, u.first_id FROM events e JOIN (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY 1) u USING (user_id) WHERE e.event_type ILIKE '%CLICK%'")
def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose type holds a word in either case, with the id their key resolves to."""
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    return search.of_kind(events, "CLICK", "event_type").join(first, "user_id").select("event_id", "first_id")


@query("""
WITH new AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS date_added FROM orders WHERE o_orderstatus <> 'O'),
first AS (SELECT l_orderkey AS id, min(l_shipdate) AS date_added FROM lineitem GROUP BY 1)
SELECT first.id, coalesce(new.status, 'old') AS status, first.date_added FROM first LEFT JOIN new USING (id)
UNION ALL SELECT new.id, new.status, new.date_added FROM new WHERE id NOT IN (SELECT id FROM first)""")
def upsert_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows replaced by parsed ones of the same id, with the date they were first seen."""
    stored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.lit("old").alias("status"), F.min("l_shipdate").alias("date_added"))
    parsed = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("date_added"))
    return reconcile.upsert(stored, parsed)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the source tree over the tables, directories included, as a written table."""
    files = sample.files(spark, sf_dir)
    nodes = extract.extract(files).drop("parsed").unionByName(directories(files.select("path")), allowMissingColumns=True)
    return written(nodes.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("inherits", "imports")}), "sources")


@query(f"""
WITH {sample.NODES_SQL}
SELECT CASE type WHEN 'file' THEN 'F' WHEN 'class' THEN 'C' WHEN 'method' THEN 'M' ELSE 'V' END || '-' || substr(md5(uid), 1, 10) AS id, uid, type, parent_uid, signature, coalesce(arity, -1)::INTEGER AS arity, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, diff_hash FROM nodes""")
def source_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a source tree with files in two languages for every region, nation, supplier and customer."""
    return extract.extract(sample.files(spark, sf_dir)).select("id", "uid", "type", "parent_uid", "signature", F.coalesce("arity", F.lit(-1)).alias("arity"), "start_line", "end_line", "diff_hash")


_FOUND = f"WITH {sample.CALLS_SQL}"


@query(f"""
WITH RECURSIVE {sample.NODES_SQL}, {sample.FOLDERS_SQL}, {sample.CALLS_SQL},
tree(id, parent_id) AS (SELECT uid, parent_uid FROM nodes UNION SELECT uid, parent_uid FROM folders),
up(source_id, target_id, edge_type) AS (
  SELECT * FROM found UNION
  SELECT s.parent_id, t.parent_id, edge_type FROM up JOIN tree s ON s.id = source_id JOIN tree t ON t.id = target_id
  WHERE s.parent_id IS NOT NULL AND t.parent_id IS NOT NULL AND s.parent_id <> t.parent_id)
SELECT DISTINCT * FROM up UNION ALL SELECT id, parent_id, 'is_child_of' FROM tree WHERE parent_id IS NOT NULL""")
def source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of that tree: resolved by every rule, lifted, and the tree itself."""
    return Resolver(_sources(spark, sf_dir)).edges()


@query(sample.IMPORTS_SQL)
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file's imports name: by uid, by path suffix, by a unique name, or everything in a file."""
    return Resolver(_sources(spark, sf_dir)).imports.select("file_uid", "candidate", "target", "is_wildcard").distinct()


@query(f"{_FOUND} SELECT DISTINCT source_id AS uid, 0::INTEGER AS ord, target_id AS base FROM found WHERE NOT contains(source_id, '(') AND NOT contains(target_id, '(')")
def resolved_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that classes inherit from."""
    return Resolver(_sources(spark, sf_dir)).bases()


@query(rf"""
{_FOUND}, {sample.NODES_SQL}, m AS (SELECT uid AS method, parent_uid, regexp_extract(uid, '([^.]*)\([^()]*\)$', 1) AS name FROM nodes WHERE type = 'method' AND contains(parent_uid, '#'))
SELECT parent_uid AS scope, regexp_replace(name, '^.*#', '') AS name, method, '' AS path FROM m
UNION ALL SELECT DISTINCT source_id, name, method, '0' FROM found JOIN m ON parent_uid = target_id WHERE NOT contains(source_id, '(')
UNION ALL SELECT parent_uid, regexp_extract(uid, '#(.*)\(', 1), uid, '' FROM nodes WHERE type = 'method' AND NOT contains(parent_uid, '#')""")
def inherited_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods that each class or file has, with the way through the bases by which it has them."""
    resolver = Resolver(_sources(spark, sf_dir))
    return resolver.inherited(resolver.bases()).select("scope", "name", "method", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query(f"{_FOUND} SELECT source_id, target_id, edge_type = 'depends_on_fuzzy' AS fuzzy FROM found WHERE contains(source_id, '(')")
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every call means, by the cascade of rules for calls."""
    resolver = Resolver(_sources(spark, sf_dir))
    return resolver.calls(resolver.bases()).select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), "fuzzy")


@query(f"WITH RECURSIVE {TREE_SQL}, {EDGES_SQL} SELECT source_id, target_id FROM dep WHERE source_id NOT IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders WHERE o_orderstatus = 'P'")
def replace_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in which those from orders under way are replaced by one to the customer."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("target_id"))
    return reconcile.replace_outbound(edges(spark, sf_dir), orders, orders.withColumnRenamed("id", "source_id").select("source_id", "target_id"))


@query("SELECT vec_id AS id, CASE WHEN label = 2 THEN 'new' ELSE 'old' END AS side, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def replace_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors in which those of one label are replaced."""
    rows = _vectors(spark, sf_dir).select("id", "vector", "label")
    side = lambda df, name: df.select("id", F.lit(name).alias("side"), F.round(F.get("vector", 0).cast("double"), 5).alias("first"))
    return reconcile.replace_vectors(side(rows, "old"), side(rows.where("label = 2"), "new"), full=False)


@query("SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AND source <> '' THEN '[STALE] ' || source ELSE source END AS description FROM documents d")
def stale_of_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of changed rows marked, those of others as they were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("description"))
    return reconcile.mark_stale(docs, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream whose micro-batches are merged into a table of the latest by key."""
    return upserted(spark, f"{sf_dir}/events.parquet", "user_id", ["ts", "event_id"], ["event_type"])
