"""What must hold when tables grow: work is spread over tasks and done once."""

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.operators import extract, graph
from graphloom.plans import sample
from graphloom.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import duck, rows_of

SF = "/root/testdata/sf0.001"


def test_many_small_files_share_a_batch():
    files = pa.RecordBatch.from_pylist([{"path": f"p{i}.py", "content": b"def f(a):\n    return g(a)\n" if i % 2 else b"", "lang": "python"} for i in range(3000)])
    got = list(extract._extractor(extract.python_nodes, "python")([files]))
    rows = [r for b in got for r in b.to_pylist()]
    assert len(got) < 10 and [r["path"] for r in rows if r["type"] == "file"] == [f"p{i}.py" for i in range(3000)]
    assert len(rows) == 4500 and rows[2]["calls"] == [{"name": "g", "arity": 1, "receiver": None, "is_creation": False}]


def test_files_of_a_small_table_are_parsed_by_many_tasks(spark, tmp_path):
    for name in ("region", "nation", "supplier"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(30_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    files = sample.files(spark, f"file://{tmp_path}")
    tasks = files.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in tasks) < 8000
    assert files.where("path like 'com/shop/%'").select("path").distinct().count() == 30_000


def test_below_is_what_ancestors_give(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "x")], "id string, parent_id string")
    scopes = spark.createDataFrame([("b",), ("a",), ("b",), ("x",), ("c",)], "scope string")
    want = graph.ancestors(nodes).where("depth > 0").join(scopes.distinct().withColumnRenamed("scope", "ancestor_id"), "ancestor_id", "left_semi").select("ancestor_id", "id")
    got = sorted(map(tuple, graph.below(nodes, scopes).collect()))
    assert got == sorted(map(tuple, want.collect())) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("x", "e")]


def test_suffix_join_of_repeated_urls(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    twice = pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1_000_000)).coalesce(1)
    twice.write.parquet(f"{tmp_path}/pages.parquet")
    got, want = QUERIES["suffix_join"](spark, f"file://{tmp_path}").toPandas(), duck(tmp_path).execute(ORACLE_SQL["suffix_join"]).df()
    assert rows_of(got) == rows_of(want) and len(want) > twice.count()


def test_lifting_walks_the_paths_of_parents_only(spark, monkeypatch):
    asked, walk = [], graph.root_paths
    monkeypatch.setattr(graph, "root_paths", lambda nodes: asked.append(nodes.count()) or walk(nodes))
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), *((f"a{i}", "a") for i in range(50)), *((f"b{i}", "b") for i in range(50)), ("c1", "gone")], "id string, parent_id string")
    edges = spark.createDataFrame([("a1", "b1", "x"), ("a2", "b2", "x"), ("a1", "b1", "y"), ("a1", "a1", "x"), ("a1", "c1", "x"), ("a3", "nowhere", "x")], "source_id string, target_id string, kind string")
    got = sorted(map(tuple, graph.lift_edges(edges, nodes, "kind").collect()))
    assert got == [("a", "b", "x"), ("a", "b", "y"), ("a", "gone", "x"), ("a1", "b1", "x"), ("a1", "b1", "y"), ("a1", "c1", "x"), ("a2", "b2", "x"), ("a3", "nowhere", "x")]
    assert asked == [3]
