"""Upkeep: after every edit the graph is that of a full parse, and only what the edit can change is read, resolved and written."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from graphloom.functions import files
from graphloom.operators import graph
from graphloom.operators.resolve import Resolver
from graphloom.plans import store
from graphloom.plans.project import Project
from graphloom.plans.store import Store, StoreError
from graphloom.sources import tree
from tests.projects import write

FILES = {
    "core/root.py": "class Root:\n    def go(self):\n        return 1\n",
    "core/mid.py": "from core.root import Root\n\n\nclass Mid(Root):\n    pass\n",
    "core/leaf.py": "from core.mid import *\n\n\nclass Leaf(Mid):\n    def run(self):\n        return self.go()\n",
    "app/use.py": "from core.leaf import Leaf\n\n\nclass Use:\n    leaf: Leaf\n\n    def all(self, x):\n        self.leaf.go()\n        return self.leaf.run()\n",
    "app/far.py": "from core import helper\nfrom core.names import only\n\n\ndef far():\n    return only(1)\n",
    "core/names.py": "x = 1\n",
    "lib/impl.py": "def only(a):\n    return a\n",
    "lib/alone.py": "def alone():\n    return alone2()\n\n\ndef alone2():\n    return 3\n",
    "old/gone.py": "from lib.impl import only\n\n\ndef g():\n    return only(2)\n",
}

#: What is written (None: deleted), and how many of the other files may be asked again.
EDITS = [
    ({"lib/alone.py": FILES["lib/alone.py"].replace("3", "4")}, 0),  # nothing that others see
    # a method that is inherited two files away goes; a unique name is so no longer
    ({"core/root.py": "class Root:\n    def went(self):\n        return 1\n", "lib/again.py": "def only(b):\n    return b\n"}, 5),
    # another base; what an import asked for comes to be; a whole directory goes
    ({"core/mid.py": "class Other:\n    def go(self):\n        return 2\n\n\nclass Mid(Other):\n    pass\n", "core/helper.py": "def h():\n    return 1\n", "old": None}, 3),
    # a class that others use goes; a name is unique again
    ({"core/leaf.py": "class Leaf2:\n    pass\n", "lib/again.py": None}, 2),
]


def everything(structs):
    """Links, edges with their kinds, imports and bases of a full resolution, by uid."""
    resolver = Resolver(structs)
    bases = resolver.all_bases()
    ends = {(r.source_id, r.target_id, r.edge_type) for r in resolver.edges().collect()}
    return {(r.s, r.t, r.fuzzy) for r in resolver.links(bases).collect()}, ends, {(r.file_uid, r.candidate, r.target) for r in resolver.imports.collect()}, {(r.uid, r.ord, r.base) for r in bases.collect()}


def stored(g):
    uid = {r.id: r.uid for r in g.structs.select("id", "uid").collect()}
    assert len(uid) == g.structs.count()
    edges = g.edges.collect()
    assert len(edges) == len({(r.source_id, r.target_id, r.edge_type) for r in edges}) and all(r.n > 0 for r in edges)
    assert {r.path for r in g.links.select("path").distinct().collect()} <= {r.path for r in g.structs.select("path").collect()}
    return {(r.source_uid, r.target_uid, r.fuzzy) for r in g.links.collect()}, {(uid[r.source_id], uid[r.target_id], r.edge_type) for r in edges}, {(r.path, r.candidate, r.target) for r in g.imports.collect()}, {(r.uid, r.ord, r.base) for r in g.bases.collect()}


def test_every_edit_equals_a_full_parse(spark, tmp_path):
    root = tmp_path / "p"
    write(root, FILES)
    project = Project(spark, f"file://{root}", f"file://{tmp_path}/g", rules=[], embed=None)
    assert stored(project.parse()) == everything(project.store.load().structs) and project.resolved is None
    for edit, others in EDITS:
        write(root, {p: t for p, t in edit.items() if t is not None})
        for p in [p for p, t in edit.items() if t is None]:
            for file in sorted((root / p).rglob("*")) if (root / p).is_dir() else [root / p]:
                file.unlink()
        rows = [(p, "deleted" if t is None else "modified") for p, t in edit.items()]
        got = project.apply(spark.createDataFrame(rows, "path string, change string"))
        if others:
            assert stored(got) == everything(got.structs), edit
        assert project.resolved <= len(edit) + others, (edit, project.resolved)
    paths = {r.path for r in got.structs.where("type = 'file'").collect()}
    assert paths == set(FILES) - {"old/gone.py"} | {"core/helper.py"}


def test_lifted_edges_are_kept_by_counts(spark):
    draw = random.Random(5)
    parents = {i: (draw.randrange(i) if i > 3 else None) for i in range(200)}
    nodes = spark.createDataFrame(list(parents.items()), "id long, parent_id long")
    paths = graph.root_paths(nodes)
    table = lambda pairs: spark.createDataFrame(list(pairs), "source_id long, target_id long")
    links = {(draw.randrange(200), draw.randrange(200)) for _ in range(150)}
    counts = graph.lift_counts(table(links), paths)
    for _ in range(3):
        removed = set(draw.sample(sorted(links), 60))
        added = {(draw.randrange(200), draw.randrange(200)) for _ in range(60)} - links
        links = links - removed | added
        counts = graph.lift_change(counts, table(removed), table(added), paths)
        expected = set()
        for s, t in links:
            while s is not None and t is not None and s != t:
                expected.add((s, t))
                s, t = parents[s], parents[t]
        assert {(r.source_id, r.target_id) for r in counts.collect()} == expected == {tuple(r) for r in graph.lift_edges(table(links), nodes).collect()}


def test_root_paths_of_deep_trees(spark):
    chain = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert {r.id: r.path for r in graph.root_paths(chain).collect()} == {i: [*range(i, -1, -1)] for i in range(300)}
    loose = spark.createDataFrame([("a", "nowhere"), ("b", "a")], "id string, parent_id string")
    assert {r.id: r.path for r in graph.root_paths(loose).collect()} == {"a": ["a", "nowhere"], "b": ["b", "a", "nowhere"]}


def test_only_changed_files_are_opened(spark, tmp_path, monkeypatch):
    write(tmp_path, {f"d{i % 20}/f{i}.py": f"x = {i}\n" for i in range(400)} | {"d0/odd [a]{b}*.PY": "y = 1\n"})
    monkeypatch.setattr(tree, "listed", None)  # nothing is listed
    paths = spark.createDataFrame([("d3/f3.py",), ("d0/missing.py",), ("d0/odd [a]{b}*.PY",), ("d3",), ("d3/f3.py",)], "path string")
    got = tree.read(f"file://{tmp_path}", paths, [])
    assert {r.path: bytes(r.content) for r in got.collect()} == {"d3/f3.py": b"x = 3\n", "d0/odd [a]{b}*.PY": b"y = 1\n"} and got.count() == 2
    opened = []
    real = tree.store_of(f"file://{tmp_path}")[0]

    class Counting:
        get_file_info = real.get_file_info

        def open_input_stream(self, path):
            opened.append(path)
            return real.open_input_stream(path)

    monkeypatch.setattr(tree, "store_of", lambda root: (Counting(), str(tmp_path)))
    batch = tree.pa.RecordBatch.from_pydict({"path": ["d3/f3.py", "none.py"], "lang": ["python", "python"]})
    assert sum(b.num_rows for b in tree._opened("")(iter([batch]))) == 1 and opened == [f"{tmp_path}/d3/f3.py"]


def test_all_source_files_are_nodes(spark, tmp_path):
    """Those of no bytes and those whose names begin with an underscore too."""
    write(tmp_path, {"pkg/__init__.py": "", "pkg/_own.py": "z = 1\n", "pkg/a b.PY": "x = 1\n", "no.txt": ""})
    want = {"pkg/__init__.py": b"", "pkg/_own.py": b"z = 1\n", "pkg/a b.PY": b"x = 1\n"}
    for root in (f"file://{tmp_path}", str(tmp_path), f"file:{tmp_path}/"):
        assert {r.path: bytes(r.content) for r in tree.scan(spark, root, []).collect()} == want
    assert tree.scan(spark, f"file://{tmp_path}/nothing", []).count() == 0


def nodes_of(spark, paths, text="x"):
    rows = [(f"F-{p}", p, p.rsplit("/", 1)[-1], "file", p, text) for p in paths]
    g = Store(spark, "file:///nowhere").empty()
    fresh = spark.createDataFrame(rows, "id string, uid string, name string, type string, path string, body string")
    return g, fresh.unionByName(g.structs.where("false"), allowMissingColumns=True)


def test_an_edit_rewrites_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PART_ROWS", 10)
    s = Store(spark, f"file://{tmp_path}/g")
    g, g.structs = nodes_of(spark, [f"d{i:03d}/a.py" for i in range(60)])
    g.edges = g.structs.select(F.col("id").alias("source_id"), F.lit("F-d000/a.py").alias("target_id"), F.lit("depends_on").alias("edge_type"), F.lit(1).cast("long").alias("n"))
    g.vectors = g.structs.select("id", F.array(F.lit(1).cast("float")).alias("vector"))
    first = s.commit(g)
    parts = s._parts(s._manifest(1))
    assert len(parts["structs"]) >= 4 and len(parts["edges"]) == len(parts["vectors"]) == len(parts["structs"])
    assert first.structs.count() == first.edges.count() == first.vectors.count() == 60
    edited = F.col("path") == "d030/a.py"
    first.structs = first.structs.withColumn("body", F.when(edited, "new").otherwise(F.col("body")))
    first.edges = first.edges.where("source_id <> 'F-d030/a.py'")
    second = s.commit(first)
    for name, changed in (("structs", 1), ("edges", 1), ("vectors", 0)):
        now = s._parts(s._manifest(2))[name]
        assert len(now) == len(parts[name]) and len({p.folder for p in now} - {p.folder for p in parts[name]}) == changed, name
    assert second.structs.where("body = 'new'").count() == 1 and second.edges.count() == 59 and second.written_in["vectors"] == 1
    assert s.load(1).edges.count() == 60
    assert s.expire(keep=1) == [1] and s.load().structs.count() == 60 and s.load().edges.count() == 59 and s.expire(keep=1) == []
    with pytest.raises(StoreError):
        s.load(1)
    assert s.clean() and not s.exists()


def test_ranges_are_split_as_they_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PART_ROWS", 10)
    s = Store(spark, f"file://{tmp_path}/g")
    g, g.structs = nodes_of(spark, [f"m{i:02d}.py" for i in range(15)] + ["same.py"] * 0)
    s.commit(g)
    assert len(s._manifest()["lows"]) == 1
    g = s.load()
    g.structs = g.structs.unionByName(nodes_of(spark, [f"a{i:02d}.py" for i in range(40)] + ["zz.py"] * 30)[1].select(g.structs.columns))
    g = s.commit(g)
    lows = s._manifest()["lows"]
    assert len(lows) > 3 and lows[0] == "" and g.structs.count() == 85
    sizes = [p.n for p in s._parts(s._manifest())["structs"]]
    assert sum(sizes) == 85 and sorted(sizes)[-1] < 60


def test_of_two_writers_one_wins(spark, tmp_path):
    base = Store(spark, f"file://{tmp_path}/g")
    g, g.structs = nodes_of(spark, ["a.py"])
    base.commit(g)
    outcome, gate = {}, threading.Barrier(4)

    def writer(k):
        own = Store(spark, base.path)
        mine = own.load()
        mine.structs = nodes_of(spark, ["a.py", f"w{k}.py"], str(k))[1]
        mine.note_high_water = k
        gate.wait()
        try:
            outcome[k] = own.commit(mine).version
        except StoreError:
            outcome[k] = None

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, outcome.values())) == ["2", "None", "None", "None"]
    winner = next(k for k, v in outcome.items() if v)
    last = base.load()
    assert (last.version, last.note_high_water) == (2, winner) and {(r.path, r.body) for r in last.structs.collect()} == {("a.py", str(winner)), (f"w{winner}.py", str(winner))}
    kept = {p.folder.split("/")[1] for v in base.versions() for own in base._parts(base._manifest(v)).values() for p in own}
    assert {p.name for p in (tmp_path / "g/data").iterdir()} == kept  # the others' files are gone
    assert not files.create_new(spark, base._named(2), "again") and files.create_new(spark, f"{base.path}/other.txt", "new")
    assert files.read_text(spark, f"{base.path}/other.txt") == "new" and files.names(spark, f"{base.path}/none") == []


def test_inheritance_on_demand(spark, tmp_path):
    write(tmp_path, FILES)
    structs = Project(spark, f"file://{tmp_path}", f"file://{tmp_path}/g", rules=[], embed=None).parse().structs
    resolver = Resolver(structs)
    bases = resolver.all_bases()
    wanted = spark.createDataFrame([("core/leaf.py#Leaf", "go"), ("core/root.py#Root", "nothing")], "scope string, name string")
    whole, some = resolver.inherited(bases), resolver.inherited(bases, wanted)
    assert some.count() == 1 and some.select(whole.columns).subtract(whole).count() == 0
