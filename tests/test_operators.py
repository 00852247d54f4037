"""Operators on small tables: edge cases and properties."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import describe, graph, notes, reconcile, search

slow = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@slow
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=12))
def test_lifting(spark, pairs):
    parent = {i: i // 2 for i in range(1, 8)} | {0: None}
    nodes = spark.createDataFrame([(str(k), None if v is None else str(v)) for k, v in parent.items()], "id string, parent_id string")
    got = graph.lift_edges(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source_id string, target_id string"), nodes)
    want, todo = set(), [(a, b) for a, b in pairs if a != b]
    while todo:
        a, b = todo.pop()
        if (a, b) not in want:
            want.add((a, b))
            pa, pb = parent[a], parent[b]
            if pa is not None and pb is not None and pa != pb:
                todo.append((pa, pb))
    assert {(int(r.source_id), int(r.target_id)) for r in got.collect()} == want


@slow
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 5), st.booleans()), max_size=12))
def test_last_writer_wins(spark, rows):
    local, incoming = {}, {}
    for key, added, updated, mine in rows:
        side = local if mine else incoming
        side[key, added] = max(side.get((key, added), (-1, ""))[0], updated), f"{'l' if mine else 'i'}"
    schema = "note_id long, struct_id string, content string, author string, date_added string, date_last_updated string"
    frame = lambda side: spark.createDataFrame([(k, str(k), f"{c}{u}", "a", str(d), str(u)) for (k, d), (u, c) in side.items()], schema)
    got = {(r.struct_id, r.date_added): r.content for r in notes.merge(frame(local), frame(incoming)).collect()}
    want = {(str(k), str(d)): f"l{local[k, d][0]}" if (k, d) in local and ((k, d) not in incoming or incoming[k, d][0] <= local[k, d][0]) else f"i{incoming[k, d][0]}" for k, d in local.keys() | incoming.keys()}
    assert got == want


def test_ring_keeps_the_last(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", "t", "x", str(i), str(i)) for i in range(30)], "note_id long, struct_id string, content string, author string, date_added string, date_last_updated string")
    kept = notes.add(rows.limit(0), rows, 4)
    assert {r.note_id for r in kept.where("struct_id = 'b'").collect()} == {18, 21, 24, 27}
    assert {r.note_id for r in notes.replace_all(rows, "a", rows.limit(0)).collect()} == set(range(0, 30, 3))


def test_note_numbers_never_repeat(spark):
    rows = spark.range(50).select(F.lit("s").alias("struct_id"), F.lit("c").alias("content"), F.format_string("%03d", "id").alias("date_added"))
    got = notes.numbered(rows, 100).orderBy("date_added").collect()
    assert [r.note_id for r in got] == list(range(101, 151))
    assert notes.numbered(rows.limit(0), 5).count() == 0


def test_nearest_and_ties(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 8)).round(1)
    data[10] = data[11] = data[12]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<double>")
    got = search.knn_join(rows.where("id < 20"), rows, 4)
    for q in range(20):
        distance = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(60), distance)) if i != q][:4]
        assert [r.id for r in got.where(F.col("query_id") == q).orderBy("nth").collect()] == want
    assert search.knn_join(rows.limit(0), rows, 4).count() == 0
    assert [r.id for r in search.nearest(rows, data[11].tolist(), 3).collect()] == [10, 11, 12]


def test_centroid_of_nothing_and_of_zero(spark):
    rows = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 0.0]), ("b", [-1.0, 0.0])], "k string, vector array<double>")
    got = {(r.k, r.i): r.value for r in search.mean_by(rows, "k").collect()}
    assert got == {("a", 0): 0.6, ("a", 1): 0.8, ("b", 0): 0.0, ("b", 1): 0.0}
    nodes = spark.createDataFrame([("r", None), ("x", "r"), ("y", "r")], "id string, parent_id string")
    leaves = spark.createDataFrame([("x", [2.0, 0.0])], "id string, vector array<double>")
    assert {r.id for r in search.subtree_centroids(nodes, leaves).collect()} == {"r", "x"}


def test_upkeep(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "id string, status string, date_added long")
    new = spark.createDataFrame([("2", "B", 9), ("3", "c", 9)], "id string, status string, date_added long")
    assert sorted(map(tuple, reconcile.upsert(old, new).collect())) == [("1", "a", 1), ("2", "B", 2), ("3", "c", 9)]
    assert sorted(map(tuple, reconcile.parsed_wins(new, old, "id").collect())) == [("1", "a", 1), ("2", "B", 9), ("3", "c", 9)]
    edges = spark.createDataFrame([("1", "2", "d"), ("2", "1", "d")], "source_id string, target_id string, edge_type string")
    got = reconcile.replace_outbound(edges, new.select("id"), spark.createDataFrame([("2", "3", "d")], edges.schema))
    assert sorted(map(tuple, got.collect())) == [("1", "2", "d"), ("2", "3", "d")]
    vectors = spark.createDataFrame([("1", [1.0]), ("2", [2.0])], "id string, vector array<double>")
    fresh = spark.createDataFrame([("2", [3.0])], vectors.schema)
    assert reconcile.replace_vectors(vectors, fresh, full=True).count() == 1 and reconcile.replace_vectors(vectors, fresh, full=False).count() == 2
    assert reconcile.replace_vectors(vectors, fresh.limit(0), full=True).count() == 2


def test_descriptions(spark):
    rows = spark.createDataFrame(
        [("F1", "e.py", "file", "", None, "", "", "h1"), ("F2", "s.py", "file", "class S: ...", None, "", "", "h2"), ("C1", "s.py#S", "class", "class S: ...", "s.py", "", "class S", "h3"), ("M1", "s.py#S.m", "method", "def m", "s.py#S", "own", "def m()", "h4")],
        "id string, uid string, type string, body string, parent_uid string, description string, signature string, diff_hash string",
    ).withColumn("name", F.lit("n")).withColumn("start_line", F.lit(1))
    lock = spark.createDataFrame([("s.py#S", "h3", "a class"), ("s.py#S.m", "h4", "other")], "uid string, diff_hash string, description string")
    got = {r.id: r.description for r in describe.described(rows, lock).collect()}
    assert got == {"F1": "Empty File", "F2": "a class", "C1": "a class", "M1": "own"}
    texts = {r.id: r.t for r in rows.select("id", describe.embedding_text().alias("t")).collect()}
    assert texts["M1"] == "s.py#S.m: own" and texts["C1"] == "s.py#S: class S: ..." and texts["F1"] == "e.py: n"
    assert {r.id for r in describe.eligible(rows).collect()} == {"F1", "F2", "C1", "M1"}
    assert "M1 | def m()\n// own" in describe.skeleton_text(rows.where("type = 'class'"), rows).first().text

    def client(texts):
        for t in texts:
            yield t.str.upper().str[:6]

    assert {r.id: r.description for r in describe.described(rows.withColumn("diff_hash", F.lit("x")), lock, client).collect()}["C1"] == "CLASS "


def test_vectors_of_models(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", "bad"), ("c", "one two")], "id string, text string")
    got = {r.id: r.vector for r in describe.hashed_vectors(rows, 16).collect()}
    assert got["a"] == got["c"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-6

    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return np.ones((len(texts), 2))

        return model

    out = {r.id: r.vector for r in describe.model_vectors(rows, load, 2, batch=1).collect()}
    assert out == {"a": [1.0, 1.0], "b": None, "c": [1.0, 1.0]}
    pooled = describe.pooled(np.array([[[3.0, 0.0], [0.0, 9.0], [1.0, 8.0]]]), np.array([[1, 0, 0]]))
    assert np.allclose(pooled, [[1.0, 0.0]])


def test_tree_walks(spark):
    nodes = spark.createDataFrame([("r", None, "directory", "."), ("a", "r", "file", "a"), ("b", "a", "class", "a#b"), ("c", "b", "method", "a#b.c"), ("d", "a", "method", "a#d")], "id string, parent_id string, type string, uid string")
    assert {r.id for r in graph.descendants(nodes, "a").collect()} == {"b", "c", "d"} and graph.descendants(nodes, "c").count() == 0
    shown = graph.skeleton(nodes, F.col("id") == "r", 5).orderBy("sort_path").collect()
    assert [(r.id, r.depth) for r in shown] == [("r", 0), ("a", 1), ("b", 2), ("d", 2)]
    assert [r.id for r in graph.skeleton(nodes, F.col("id") == "r", 5, files_only=True).orderBy("sort_path").collect()] == ["r", "a"]


def test_suffixes_of_many_files_of_one_name(spark):
    """20,000 ``__init__.py``: only those that the whole candidate names meet it."""
    nodes = spark.range(20_000).select(F.format_string("src/p%d/q/__init__.py", "id").alias("uid"))
    wanted = spark.range(0, 20_000, 40).select(F.format_string("p%d/q/__init__.py", "id").alias("candidate")).unionByName(spark.createDataFrame([("r/q/__init__.py",), ("q",), ("src/p7/q/__init__.py",)], "candidate string"))
    found = graph.suffix_matches(wanted, nodes)
    got = {(r.candidate, r.uid) for r in found.collect()}
    assert got == {(f"p{i}/q/__init__.py", f"src/p{i}/q/__init__.py") for i in range(0, 20_000, 40)} | {("src/p7/q/__init__.py",) * 2}
    assert "EqualTo" not in found._jdf.queryExecution().toString() or "endswith" not in found._jdf.queryExecution().toString()


def test_many_queries_in_one_plan(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 600)
    monkeypatch.setattr(search, "ROWS", 900)
    rng = np.random.default_rng(2)
    data = rng.normal(size=(5200, 3)).round(1)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "id long, vector array<double>")
    found = search.knn_join(rows.where("id < 5000"), rows, 3)
    plan = found._jdf.queryExecution().toString()
    assert plan.count("FlatMapCoGroups") <= 8
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.nth] = r.id
    assert len(got) == 5000
    for i in range(0, 5000, 97):
        distance = np.sqrt(((data - data[i]) ** 2).sum(axis=1))
        order = [int(k) for k in np.lexsort((np.arange(5200), distance)) if k != i][:3]
        assert [got[i][n] for n in (1, 2, 3)] == order
    assert search.knn_join(rows.limit(0), rows).count() == 0 and search.knn_join(rows, rows.limit(0)).count() == 0
