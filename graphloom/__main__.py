"""Commands on a project: python -m graphloom --root DIR COMMAND ..."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from graphloom.operators import describe
from graphloom.plans.project import Project, config
from graphloom.plans.store import StoreError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    top.add_argument("--root", default=".", help="the source tree")
    top.add_argument("--store", help="the graph's folder; .graph below the root otherwise")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *names: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for n in names:
            p.add_argument(n)
        for n, default in options.items():
            flag = {"action": "store_true"} if default is False else {"type": type(default), "default": default} if default is not None else {}
            p.add_argument("--" + n.replace("_", "-"), **flag)
        return p

    command("init", "write the settings and the ignore rules of a project", force=False)
    command("parse", "scan the tree and commit its graph", language="auto", lock=None, llm=None)
    command("watch", "keep the graph fresh until stopped", seconds=1.0, llm=None)
    command("status", "count nodes by kind, edges and notes")
    command("inspect", "what is known of nodes, by id or uid", "refs", body=False, max_lines=500)
    command("skeleton", "the tree below a path", "path", depth=4, files_only=False, max_lines=500)
    command("search", "the nodes nearest to a text", "text", top_k=5, filter=None)
    command("note-add", "annotate a node", "ref", "content", author="agent")
    command("note-edit", "change a note", "note_id", "content", author="agent")
    command("note-remove", "delete a note", "note_id")
    command("export", "write descriptions and notes to the lockfile", lock="graph.lock.json", with_vectors=False)
    command("clean", "delete the graph")
    return top


def init(root: Path, force: bool = False) -> list[str]:
    """Write ``graph.toml`` and ``.graphignore`` with the defaults, and keep the graph out of git; what was written."""
    from graphloom.sources.ignore import DEFAULTS

    texts = {"graph.toml": '[project]\nlanguage = "auto"\n', ".graphignore": "\n\n".join("\n".join([f"# {lang}", *rules]) for lang, rules in DEFAULTS.items() if rules) + "\n"}
    done = [name for name in texts if force or not (root / name).exists()]
    for name in done:
        (root / name).write_text(texts[name], encoding="utf-8")
    ignored = root / ".gitignore"
    lines = ignored.read_text(encoding="utf-8").splitlines() if ignored.exists() else []
    if ".graph/" not in lines:
        ignored.write_text("\n".join([*lines, ".graph/"]) + "\n", encoding="utf-8")
        done.append(".gitignore")
    return done


def project(spark: SparkSession, root: Path, store: str | None, language: str = "auto", llm: str | None = None) -> Project:
    own = root / ".graphignore"
    rules = own.read_text(encoding="utf-8").splitlines() if own.exists() else None
    language = language if language != "auto" else config(root).get("project", {}).get("language", "auto")
    client = describe.client_for(config(root), describe.CLIENTS, llm)
    return Project(spark, f"file://{root}", store or f"file://{root}/.graph", language=language, rules=rules, client=client)


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    root = Path(args.root).absolute()
    p = project(spark, root, args.store, getattr(args, "language", "auto"), getattr(args, "llm", None))
    match args.command:
        case "init":
            return "\n".join(init(root, args.force)) or "nothing to write"
        case "parse":
            return f"version {p.parse(f'file://{Path(args.lock).absolute()}' if args.lock else None).version}"
        case "watch":
            from graphloom.streaming.watch import watch

            watch(p, str(root), f"{p.store.path}-watch", args.seconds).awaitTermination()
            return "stopped"
        case "status":
            return "\n".join(f"{k}: {v}" for k, v in p.status().items())
        case "inspect":
            return p.inspect(args.refs, args.body, args.max_lines)
        case "skeleton":
            return p.skeleton(args.path, args.depth, args.files_only, args.max_lines)
        case "search":
            return "\n".join(f"{r.id}|{r.uid} ({r.type}) {r.distance:.4f}" for r in p.search(args.text, args.top_k, args.filter).collect()) or "nothing found"
        case "note-add":
            return f"note {p.note_add(args.ref, args.content, args.author)}"
        case "note-edit":
            return "changed" if p.note_edit(int(args.note_id), args.content, args.author) else "no such note"
        case "note-remove":
            return "removed" if p.note_remove(int(args.note_id)) else "no such note"
        case "export":
            return str(p.export(Path(args.lock) if Path(args.lock).is_absolute() else root / args.lock, args.with_vectors))
        case _:
            return "cleaned" if p.store.clean() else "nothing to clean"


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        print(run(args, spark))
        return 0
    except (StoreError, describe.ClientError) as e:
        print(f"error: {e}")
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
