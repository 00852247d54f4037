"""The commands, one after the other on a project."""

import pytest

from graphloom.__main__ import parser, project, run
from graphloom.plans.project import config
from graphloom.plans.store import Store, StoreError
from tests.projects import write


def test_commands(spark, tmp_path):
    write(tmp_path, {"a.py": "def f():\n    return 1\n\n\ndef g():\n    return f()\n", "build/b.py": "x = 1\n"})
    call = lambda *words: run(parser().parse_args(["--root", str(tmp_path), *words]), spark)
    with pytest.raises(StoreError):
        call("status")
    assert call("init").split("\n") == ["graph.toml", ".graphignore", ".gitignore"] and call("init") == "nothing to write"
    assert config(tmp_path) == {"project": {"language": "auto"}} and ".graph/" in (tmp_path / ".gitignore").read_text()
    assert call("parse") == "version 1"
    assert "method: 2" in call("status") and "file: 1" in call("status")
    assert "def f()" in call("inspect", "a.py#f(...)", "--body") and "#g(...)" in call("skeleton", ".")
    assert call("search", "return f", "--top-k", "1", "--filter", "method").count("\n") == 0
    assert call("note-add", "a.py", "look") == "note 1" and call("note-edit", "1", "see") == "changed"
    assert "[1] agent" in call("inspect", "a.py") and "'notes': 1" in call("export")
    assert call("note-remove", "1") == "removed" and call("note-remove", "1") == "no such note"
    assert call("parse", "--lock", str(tmp_path / "graph.lock.json")).startswith("version")
    assert call("clean") == "cleaned" and call("clean") == "nothing to clean"


def test_incompatible_store(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    (tmp_path / "g/manifest").mkdir(parents=True)
    (tmp_path / "g/manifest/000000000004.json").write_text('{"version": 4, "format_version": 99, "note_high_water": 0, "tables": {}, "parts": {}}')
    with pytest.raises(StoreError):
        Store(spark, path).load()
    assert Store(spark, path).before().version == 4 and Store(spark, path).before().structs.count() == 0


def test_settings_name_the_client(spark, tmp_path, monkeypatch):
    from graphloom.operators import describe

    def loud(texts):
        for t in texts:
            yield t.str.upper()

    monkeypatch.setitem(describe.CLIENTS, "loud", loud)
    write(tmp_path, {"a.py": "x = 1\n", "graph.toml": '[llm]\nstrategy = "loud"\n'})
    assert project(spark, tmp_path, None).client is loud and project(spark, tmp_path, None, llm="none").client is None
    with pytest.raises(describe.ClientError):
        project(spark, tmp_path, None, llm="quiet")
    assert parser().parse_args(["parse", "--llm", "loud"]).llm == "loud"
