"""Parsing, upkeep and questions over a small project."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import ident
from graphloom.operators import describe, extract
from graphloom.operators.java import _calls, erased, import_candidate, java_nodes
from graphloom.plans.project import Project, clipped, parse_refs
from graphloom.plans.store import StoreError
from graphloom.sources import ignore, tree
from tests.projects import FILES, JAVA, write


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root, store = tmp_path_factory.mktemp("project"), tmp_path_factory.mktemp("store")
    write(root, FILES)
    project = Project(spark, f"file://{root}", f"file://{store}/graph", rules=[])
    return project, project.parse(), root


def named(g):
    """Edges by uid."""
    uids = {r.id: r.uid for r in g.structs.select("id", "uid").collect()}
    return {(uids[r.source_id], uids[r.target_id]) for r in g.edges.where("edge_type <> 'is_child_of'").collect()}


def whole(g):
    """No edge, vector or note without its node; ids unique."""
    ids = [r.id for r in g.structs.select("id").collect()]
    assert len(ids) == len(set(ids))
    for df, column in ((g.edges, "source_id"), (g.edges, "target_id"), (g.vectors, "id"), (g.notes, "struct_id")):
        assert {r[0] for r in df.select(column).collect()} <= set(ids)


def test_counts_and_golden_ids(parsed):
    _, g, _ = parsed
    kinds = {r["type"]: r["count"] for r in g.structs.groupBy("type").count().collect()}
    assert kinds == {"directory": 2, "file": 4, "class": 3, "method": 15, "field": 6}
    ids = {r.uid: r.id for r in g.structs.select("uid", "id").collect()}
    assert ids["."] == "D-5058f1af83" and ids["services"] == "D-10cd395cf7" and ids["models.py"] == "F-f219bfe69e"
    assert ids["models.py#User"] == "C-a6fe0e1eec" and ids["models.py#User.validate(...)"] == "M-cba869f335"
    assert ids["models.py#User.name"] == "V-d4c080a627" and ids["utils.py#format_currency(...)"] == "M-6f26a603aa"
    assert g.edges.where("edge_type = 'is_child_of'").count() == len(ids) - 1
    whole(g)


def test_edges(parsed):
    _, g, _ = parsed
    service = "services/user_service.py#UserService"
    expected = {
        ("models.py#User.validate(...)", "models.py#User.check_name(...)"),
        ("models.py#User.validate(...)", "models.py#User.check_email(...)"),
        ("utils.py#summarize(...)", "utils.py#format_currency(...)"),
        (f"{service}.create_user(...)", "models.py#User"),
        (f"{service}.get_display(...)", "models.py#User.get_display_name(...)"),
        (f"{service}.validate_user(...)", "models.py#User.validate(...)"),
        (f"{service}.format_price(...)", "utils.py#format_currency(...)"),
        (service, "models.py#User"),
        (service, "utils.py#format_currency(...)"),
        (service, "models.py"),
        ("services/user_service.py", "models.py"),
        ("services", "."),
        ("main.py#run(...)", f"{service}.get_display(...)"),
        ("main.py", service),
    }
    assert expected <= named(g)
    assert ("main.py#run(...)", "models.py#User") not in named(g)


def test_directory_vectors_are_means_of_files(parsed):
    _, g, _ = parsed
    rows = {r.id: r.vector for r in g.vectors.collect()}
    assert abs(sum(x * x for x in rows["D-5058f1af83"]) - 1) < 1e-5
    assert not any(i.startswith("V-") for i in rows)


def test_questions(parsed):
    project, g, _ = parsed
    text = project.inspect("models.py#User, nothing.py")
    assert "C-a6fe0e1eec @L1-19 | class User" in text and "not found: nothing.py" in text and "methods:" in text
    assert "def total(self, n: int = 1, *args, **kw)" in project.inspect(["models.py#Product"])
    shown = project.skeleton(".", 2).split("\n")
    assert shown[0] == "D-5058f1af83 | ." and "    F-f219bfe69e | models.py" in shown and "        M-6f26a603aa | #format_currency(...)" in shown
    assert not any("validate" in line for line in shown)
    with pytest.raises(StoreError):
        project.skeleton("missing")
    near = project.search("format currency value", 3, "METHOD").collect()
    assert len(near) == 3 and {r.type for r in near} == {"method"} and near[0].uid == "utils.py#format_currency(...)"
    assert project.status()["class"] == 3
    assert {r.uid for r in project.subtree("services").where("type = 'file'").collect()} == {"services/user_service.py"}
    assert "models.py#User.name" in {r.uid for r in project.around("models.py#User").collect()}


def test_store_guard(spark, tmp_path):
    with pytest.raises(StoreError):
        Project(spark, f"file://{tmp_path}", f"file://{tmp_path}/none").status()


def test_updates_equal_a_full_parse(spark, tmp_path):
    root = tmp_path / "p"
    write(root, FILES | JAVA)
    project = Project(spark, f"file://{root}", f"file://{tmp_path}/g", rules=[], embed=None)
    project.parse()
    kept = project.note_add("models.py#User", "look here")
    lost = project.note_add("utils.py#shout(...)", "goes with its node")
    write(root, {"utils.py": FILES["utils.py"].replace("def shout(text):\n    return text.upper()\n", "def whisper(text):\n    return text.lower()\n"), "new/deep/x.py": "from utils import whisper\n\n\ndef f(a):\n    return whisper(a)\n"})
    (root / "main.py").unlink()
    rows = [("utils.py", "modified"), ("new/deep/x.py", "added"), ("main.py", "deleted")]
    got = project.apply(spark.createDataFrame(rows, "path string, change string"))
    fresh = Project(spark, f"file://{root}", f"file://{tmp_path}/h", rules=[], embed=None).parse()
    columns = ("id", "uid", "type", "parent_uid", "diff_hash", "start_line")
    assert sorted(map(str, got.structs.select(*columns).collect())) == sorted(map(str, fresh.structs.select(*columns).collect()))
    assert named(got) == named(fresh)
    assert ("new/deep/x.py#f(...)", "utils.py#whisper(...)") in named(got)
    assert [r.note_id for r in got.notes.collect()] == [kept] and lost not in [r.note_id for r in got.notes.collect()]
    assert project.note_add("models.py", "never reused") == lost + 1
    assert project.note_edit(kept, "changed", "me") and not project.note_edit(99, "x")
    assert project.note_remove(kept) and not project.note_remove(kept)
    whole(project.store.load())
    gone = project.apply(spark.createDataFrame([("com", "deleted")], "path string, change string"))
    assert not [r for r in gone.structs.select("path").collect() if r.path.startswith("com")]


def test_lockfile_round_trip(spark, tmp_path):
    root, lock = tmp_path / "p", tmp_path / "lock.json"
    write(root, {"a.py": "def f():\n    return 1\n\n\ndef g():\n    return f()\n"})
    project = Project(spark, f"file://{root}", f"file://{tmp_path}/g", rules=[], embed=None)
    g = project.parse()
    g.structs = g.structs.withColumn("description", F.when(F.col("name") == "f", "says one").when(F.col("name") == "g", "[STALE] old").otherwise(""))
    project.store.commit(g)
    project.note_add("a.py#f(...)", "first")
    out = project.export(lock)
    assert out == {"descriptions": 1, "notes": 1, "changed": True} and not project.export(lock)["changed"]
    assert list(json.loads(lock.read_text())["entries"]) == ["a.py#f(...)"]
    other = Project(spark, f"file://{root}", f"file://{tmp_path}/h", rules=[], embed=None)
    for _ in range(2):  # merging twice changes nothing
        h = other.parse(f"file://{lock}")
        assert {r.uid: r.description for r in h.structs.where("description <> ''").collect()} == {"a.py#f(...)": "says one"}
        assert [(r.content, r.note_id) for r in h.notes.collect()] == [("first", 1)]
    (tmp_path / "bad.json").write_text("{")
    assert other.parse(f"file://{tmp_path}/bad.json").notes.count() == 1


def test_watching(spark, tmp_path):
    from graphloom.streaming.watch import Watchers, watch

    root = tmp_path / "p"
    write(root, {"a.py": "def f():\n    return 1\n", "b.py": "x = 1\n"})
    project = Project(spark, f"file://{root}", f"file://{tmp_path}/g", rules=[], embed=None)
    run = lambda: watch(project, str(root), f"file://{tmp_path}/c", once=True).awaitTermination(120)
    run()
    assert {r.uid for r in project.store.load().structs.where("type = 'file'").collect()} == {"a.py", "b.py"}
    (root / "b.py").unlink()
    write(root, {"a.py": "def g():\n    return 22\n"})
    run()
    assert {r.uid for r in project.store.load().structs.where("type <> 'directory'").collect()} == {"a.py", "a.py#g(...)"}
    watchers = Watchers()
    query = watchers.start(project, str(root), f"file://{tmp_path}/d")
    watchers.stop(str(root))
    assert not query.isActive


def test_ignore_rules(spark):
    rules = ["*.log", "!important.log", "/top", "dist/", "docs/**", "a/*/c.py", "# note", ""]
    cases = {("x.log", False): True, ("important.log", False): False, ("top", False): True, ("sub/top", False): False, ("dist", True): True, ("dist", False): False, ("dist/important.log", False): True, ("docs/a/b.py", False): True, ("a/b/c.py", False): True, ("a/b/d/c.py", False): False, (".", True): False, ("m.pyc", False): True, ("p/__pycache__/m.py", False): True, ("src/a.py", False): False}
    df = spark.createDataFrame([(p, d) for p, d in cases], "path string, dir boolean").select("path", "dir", ignore.is_ignored(F.col("path"), F.col("dir"), rules).alias("hit"))
    assert {(r.path, r.dir): r.hit for r in df.collect()} == cases


def test_scan_gates_language_and_defaults(spark, tmp_path):
    write(tmp_path, {"a.py": "x = 1\n", "build/b.py": "y = 1\n", "J.java": "class J {}\n", "h.html": "<p>\n", "r.txt": "no"})
    paths = lambda **k: {r.path for r in tree.scan(spark, f"file://{tmp_path}", **k).collect()}
    assert paths() == {"a.py", "J.java", "h.html"}
    assert paths(language="java") == {"J.java"}
    assert paths(rules=[]) == {"a.py", "build/b.py", "J.java", "h.html"}


def test_java():
    nodes = {n["uid"]: n for n in java_nodes("com/x/A.java", JAVA["com/x/A.java"].encode())}
    file = "com/x/A.java"
    assert set(nodes) == {file, f"{file}#A", f"{file}#A.items", f"{file}#A.n", f"{file}#A.A(int)", f"{file}#A.run(int, List)", f"{file}#A.helper(int)", f"{file}#A.Inner", f"{file}#A.Inner.z()"}
    assert nodes[f"{file}#A"]["inherits"] == ["Base", "I", "K"] and nodes[file]["package"] == "com/x"
    assert nodes[file]["imports"] == ["java/util/List.java#List", "com/x/Base.java#Base"]
    assert {"name": "Base", "arity": 1, "receiver": None, "is_creation": True} in nodes[f"{file}#A.run(int, List)"]["calls"]
    assert erased("java.util.Map<String, List<Integer>>") == "Map" and erased("int ...") == "int[]"
    assert erased("java.util.Map.Entry<K, V> [] []") == "Map.Entry[][]" and erased("some.odd.type") == "type" and erased("byte[]...") == "byte[][]"
    assert import_candidate("a.b", True) == "a/b.*"


def calls_in(body):
    return [(c["name"], c["arity"], c["receiver"], c["is_creation"]) for c in _calls(body)]


def test_java_calls():
    assert calls_in("{ this.run(a).go(b, c); }") == [("run", 1, "this", False), ("go", 2, "this.run(a)", False)]
    assert calls_in("{ new A.B<X, Y>(1, f(2, 3)).z(); }") == [("A.B", 2, None, True), ("f", 2, None, False), ("z", 0, "new A.B      (1, f(2, 3))", False)]
    assert calls_in("{ if (a < b) { x[1] . get(a < b, c > d); } return (q).w(); super.end(); }") == [("get", 2, "x[1]", False), ("w", 0, "(q)", False), ("end", 0, "super", False)]
    assert calls_in("{ go(new int[]{1, 2}, m -> { h(m, 1); }); }") == [("go", 2, None, False), ("h", 2, None, False)]
    assert calls_in("{ broken(a, (b; }")[0][:2] == ("broken", 2)


def test_java_calls_are_linear():
    import time

    began = time.perf_counter()
    assert len(_calls("{ x" + ".a()" * 20_000 + "; }")) == 20_000 and len(_calls("{ " + "f(" * 5_000 + ")" * 5_000 + " }")) == 5_000
    assert not _calls("a." * 30_000) and time.perf_counter() - began < 20


def test_java_resolution(spark, tmp_path):
    write(tmp_path, JAVA)
    g = Project(spark, f"file://{tmp_path}", f"file://{tmp_path}/g", rules=[], embed=None).parse()
    edges = named(g)
    assert ("com/x/A.java#A", "com/x/Base.java#Base") in edges
    assert ("com/x/A.java#A.A(int)", "com/x/A.java#A.helper(int)") in edges
    assert ("com/x/A.java#A.run(int, List)", "com/x/Base.java#Base") in edges


def test_python_resolution_rules(spark, tmp_path):
    write(
        tmp_path,
        {
            "src/pkg/a.py": "class A:\n    def go(self):\n        pass\n",
            "src/pkg/cmd.py": "from pkg.a import A\n\n\nclass C(A):\n    f: A\n\n    def run(self):\n        self.go()\n        self.f.go()\n",
            "src/pkg/rel.py": "from .a import A\nfrom logging import getLogger\n\n\ndef make():\n    getLogger()\n    return A()\n",
            "src/pkg/other.py": "def getLogger():\n    pass\n",
            "src/pkg/wild.py": "from pkg.a import *\n\n\ndef w():\n    return A()\n",
            "two/x.py": "class X:\n    def same(self):\n        pass\n\n\nclass Y:\n    def same(self):\n        pass\n",
            "two/y.py": "from two.x import X, Y\n\n\ndef f(thing, x):\n    thing.same()\n    x.same()\n",
            "broken.py": "def (:\n",
        },
    )
    g = Project(spark, f"file://{tmp_path}", f"file://{tmp_path}/g", rules=[], embed=None).parse()
    edges = named(g)
    a = "src/pkg/a.py#A"
    assert {("src/pkg/cmd.py#C", a), ("src/pkg/cmd.py#C.run(...)", f"{a}.go(...)"), ("src/pkg/rel.py#make(...)", a), ("src/pkg/wild.py#w(...)", a)} <= edges
    assert not [e for e in edges if e[0] == "src/pkg/rel.py#make(...)" and "other" in e[1]]
    uids = {r.id: r.uid for r in g.structs.select("id", "uid").collect()}
    fuzzy = {(uids[r.source_id], uids[r.target_id]) for r in g.edges.where("edge_type = 'depends_on_fuzzy'").collect()}
    assert ("two/y.py#f(...)", "two/x.py#X.same(...)") in fuzzy and ("two/y.py#f(...)", "two/x.py#Y.same(...)") in fuzzy
    assert {r.uid for r in g.structs.where("path = 'broken.py'").collect()} == {"broken.py"}


def test_no_file_fails_the_job(spark):
    deep = b"x = " + b"(" * 5000 + b")" * 5000
    files = {
        "cr.py": b"class A:\r    def f(self):\r        return 1\r",
        "crlf.py": b"def g(a):\r\n    return a\r\n",
        "bom.py": b"\xef\xbb\xbfdef h():\n    pass\n",
        "latin.py": b"# -*- coding: latin-1 -*-\ndef k(x='\xe9', y=2):\n    pass\n\n\nz\xe9 = 1\n",
        "deep.py": deep,
        "null.py": b"a = 1\x00\n",
        "coding.py": b"# coding: nonsense\n",
        "half.py": b"import os\n\n\nclass B:\n    def ok(self):\n        return 1\n\n    def bad(self:\n        return 2\n\n    @staticmethod\n    def last():\n        pass\n\n\ndef good(a, b):\n    return a\n\n\nx = = 1\n",
        "empty.py": b"",
        "odd.java": b"class { void (((",
    }
    rows = [(p, bytearray(c), "java" if p.endswith("java") else "python") for p, c in files.items()]
    got = {r.uid: r for r in extract.extract(spark.createDataFrame(rows, "path string, content binary, lang string")).collect()}
    assert set(files) <= set(got)
    assert got["cr.py#A.f(...)"].body == "def f(self):\r        return 1" and got["crlf.py#g(...)"].body == "def g(a):\r\n    return a"
    assert got["bom.py#h(...)"].start_line == 1 and got["latin.py#k(...)"].signature == "def k(x='é', y=2)" and "latin.py#zé" in got
    assert {u for u in got if u.startswith("half.py")} == {"half.py", "half.py#B", "half.py#B.ok(...)", "half.py#B.last(...)", "half.py#good(...)"}
    assert got["half.py#good(...)"].start_line == 16 and got["half.py#B.last(...)"].start_line == 12 and got["half.py#B"].end_line == 13
    assert {u: r.parsed for u, r in got.items() if u in ("half.py", "deep.py", "null.py", "coding.py", "cr.py", "empty.py")} == {"half.py": False, "deep.py": False, "null.py": False, "coding.py": False, "cr.py": True, "empty.py": True}


def test_a_broken_save_loses_nothing(spark, tmp_path):
    root = tmp_path / "p"
    write(root, {"a.py": "class A:\n    def f(self):\n        return 1\n", "b.py": "from a import A\n\n\ndef g(x):\n    return A()\n"})
    project = Project(spark, f"file://{root}", f"file://{tmp_path}/g", rules=[], embed=None)
    g = project.parse()
    g.structs = g.structs.withColumn("description", F.when(F.col("name") == "f", "gives one").otherwise(""))
    project.store.commit(g, ("structs",))
    note = project.note_add("a.py#A.f(...)", "keep me")
    for text, again in (("class A:\n    def f(self:\n        return 1\n", lambda: project.apply(spark.createDataFrame([("a.py", "modified")], "path string, change string"))), ("class A(\n\0", project.parse)):
        write(root, {"a.py": text})
        for got in (again(),):
            assert {r.uid: r.description for r in got.structs.where("path = 'a.py'").collect()} == {"a.py": "", "a.py#A": "", "a.py#A.f(...)": "gives one"}
            assert [r.note_id for r in got.notes.collect()] == [note] and ("b.py#g(...)", "a.py#A") in named(got)
    write(root, {"a.py": "class A:\n    pass\n"})
    got = project.apply(spark.createDataFrame([("a.py", "modified")], "path string, change string"))
    assert {r.uid for r in got.structs.where("path = 'a.py'").collect()} == {"a.py", "a.py#A"} and got.notes.isEmpty()


def test_changed_files_are_stale_until_described(spark, tmp_path):
    import pandas as pd

    def client(texts):
        for part in texts:
            yield pd.Series([f"about {t.split(chr(10))[0]}" for t in part])

    root = tmp_path / "p"
    write(root, {"a.py": "class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n"})
    project = Project(spark, f"file://{root}", f"file://{tmp_path}/g", rules=[], embed=None, client=client)
    g = project.parse()
    by = lambda g: {r.name: r.description for r in g.structs.where("type in ('class', 'method', 'file')").collect()}
    assert by(g)["f"] == "about a.py#A.f(...): def f(self):" and by(g)["A"] == "about class A" and by(g)["a.py"] == by(g)["A"]
    write(root, {"a.py": "class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return 3\n"})
    after = project.apply(spark.createDataFrame([("a.py", "modified")], "path string, change string"))
    assert after.version == g.version + 2 and by(after) == by(g)
    first = project.store.load(g.version + 1).structs
    assert {r.name: r.description for r in first.where("type = 'method'").collect()} == {"f": f"[STALE] {by(g)['f']}", "g": ""}


def test_classes_are_described_after_their_children(spark):
    import pandas as pd

    seen = spark.sparkContext.accumulator(0)

    def client(texts):
        for part in texts:
            seen.add(len(part))
            yield pd.Series([f"<{t}>" for t in part])

    files = [("a.py", bytearray(b"class A:\n    class B:\n        def f(self):\n            pass\n\n    def g(self):\n        pass\n"), "python")]
    nodes = extract.extract(spark.createDataFrame(files, "path string, content binary, lang string")).withColumn("description", F.lit(""))
    lock = spark.createDataFrame([], "uid string, diff_hash string, description string")
    got = {r.name: r.description for r in describe.described(nodes, lock, client).collect()}
    assert got["B"].startswith("<class B\nM-") and got["f"] in got["B"] and got["B"] in got["A"] and got["g"] in got["A"] and got["a.py"] == got["A"]
    assert seen.value == 4


def test_clients():
    import pandas as pd

    tries = []

    def call(text):
        tries.append(text)
        if text == "bad":
            raise ValueError(text)
        if tries.count(text) < 3:
            raise TimeoutError
        return text.upper()

    client = describe.retrying(call, attempts=3, backoff=0.0)
    assert [x.tolist() for x in client(iter([pd.Series(["a", "bad", "b"])]))] == [["A", None, "B"]] and tries.count("bad") == 1
    assert describe.retrying(call, attempts=1, backoff=0.0)(iter([pd.Series(["c"])])).__next__().tolist() == [None]
    known = {"x": client}
    assert describe.client_for({}, known) is None and describe.client_for({"llm": {"strategy": "x"}}, known) is client
    assert describe.client_for({"llm": {"strategy": "x"}}, known, "none") is None
    with pytest.raises(describe.ClientError):
        describe.client_for({"llm": {"strategy": "y"}}, known)


def test_notes_cost_their_own_table(spark, tmp_path):
    write(tmp_path / "p", {"a.py": "x = 1\n"})
    project = Project(spark, f"file://{tmp_path}/p", f"file://{tmp_path}/g", rules=[], embed=None)
    first = project.parse()
    project.note_add("a.py", "one")
    g = project.store.load()
    assert g.written_in == dict.fromkeys(g.written_in, 1) | {"notes": 2} and not [*(tmp_path / "g/data").glob("structs-2-*")]
    assert project.status()["bytes"] > 0 and {r.id: r["at"] for r in project.last_updated().collect()}
    with pytest.raises(StoreError):
        project.store.commit(first)  # another writer was faster
    project.parse()
    project.note_add("a.py", "two")
    assert project.store.expire(keep=1) == [1, 2] and {r.content for r in project.store.load().notes.collect()} == {"one", "two"}
    assert project.store.expire(keep=1) == []


def test_python_imports():
    nodes = list(extract.python_nodes("src/pkg/cmd.py", b"import os.path\nfrom pkg.a import A as B\nfrom math import *\n\n\ndef f(a, *b, c=1):\n    B(a)\n"))
    assert nodes[0]["imports"][:2] == ["os/path.py", "os/path/__init__.py"]
    assert "src/pkg/a.py#A" in nodes[0]["imports"] and "pkg/a.py#A(...)" in nodes[0]["imports"] and "math.py.*" in nodes[0]["imports"]
    assert nodes[1]["arity"] == 3 and nodes[1]["signature"] == "def f(a, *b, c=1)"
    assert nodes[1]["calls"] == [{"name": "A", "arity": 1, "receiver": None, "is_creation": False}]


def test_helpers():
    assert parse_refs("a, b(int, String)") == ["a", "b(int, String)"] and parse_refs('["x"]') == ["x"] and parse_refs(["y"]) == ["y"]
    assert clipped("a\nb\nc", 2) == "a\nb\n... (1 more lines)" and clipped("a", 2) == "a"
    assert ident.kind_of("M-6f26a603aa") == "method" and ident.kind_of("models.py") is None
