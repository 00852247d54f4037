"""A project's graph: parse, keep fresh, ask."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ident
from graphloom.functions.scratch import written
from graphloom.operators import describe, extract, graph, notes, reconcile, search
from graphloom.operators.resolve import Resolver, affected
from graphloom.plans.store import LOCK_FORMAT, Graph, Store, StoreError
from graphloom.sources import lockfile, tree

#: The kinds of one vocabulary, lower-case, everywhere.
KINDS = ("directory", "file", "class", "method", "field")


def config(root: Path, name: str = "graph.toml") -> dict:
    """The project's settings: ``[project] language`` and ``[llm]``; none without the file."""
    path = root / name
    return tomllib.loads(path.read_text(encoding="utf-8")) if path.exists() else {}


def parse_refs(value: str | list[str]) -> list[str]:
    """Ids or uids given as a list, a JSON list or separated by commas outside of brackets."""
    if isinstance(value, list):
        return [str(v).strip() for v in value]
    if value.strip().startswith("["):
        try:
            return [str(v).strip() for v in json.loads(value)]
        except ValueError:
            pass
    out, depth = [""], 0
    for c in value:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [v.strip() for v in out if v.strip()]


def clipped(text: str, lines: int) -> str:
    rows = text.split("\n")
    return text if len(rows) <= lines else "\n".join([*rows[:lines], f"... ({len(rows) - lines} more lines)"])


class Project:
    """``root`` is a source tree that Spark reads, ``store`` the folder of its graph."""

    def __init__(self, spark: SparkSession, root: str, store: str, language: str = "auto", rules: list[str] | None = None, embed: Callable[[DataFrame], DataFrame] | None = describe.hashed_vectors, client: Callable | None = None):
        self.spark, self.root, self.store = spark, root, Store(spark, store)
        self.language, self.rules, self.embed, self.client = language, rules, embed, client
        #: How many files the last change had resolved; None after a full parse.
        self.resolved: int | None = None

    # -- building ---------------------------------------------------------------------------------

    def _structs(self, files: DataFrame, paths: DataFrame) -> DataFrame:
        now = F.current_timestamp()
        nodes = extract.extract(files).unionByName(tree.directories(paths), allowMissingColumns=True)
        nodes = nodes.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("inherits", "imports")})
        return nodes.withColumns({"description": F.lit(""), "diff_hash": F.coalesce("diff_hash", F.lit("")), "date_added": now, "date_last_updated": now})

    def _edges(self, structs: DataFrame, before: Graph, changed: DataFrame | None) -> dict[str, DataFrame]:
        """edges, links, imports and bases of ``structs``.

        With the files ``changed`` (path) since the version before, only files are resolved whose names can
        mean something else now, and only edges are counted anew that their links imply.
        """
        asking = written(affected(changed, before.structs, structs, before.imports, before.bases), "affected") if changed is not None else None
        self.resolved = asking.count() if asking is not None else None
        resolver = Resolver(structs, asking, before.bases if asking is not None else None)
        bases = written(resolver.all_bases(), "bases")
        path = lambda c: F.substring_index(c, "#", 1).alias("path")
        links = written(resolver.links(bases).select(path("s"), F.col("s").alias("source_uid"), F.col("t").alias("target_uid"), "fuzzy"), "links")
        imports = resolver.imports.select(F.col("file_uid").alias("path"), "ord", "candidate", "target", "is_wildcard")
        bases = bases.select(path("uid"), "uid", "ord", "base")
        if asking is None:
            edges = self._lifted(links, structs, graph.lift_counts).unionByName(self._contained(structs))
            return {"edges": edges, "links": links, "imports": imports, "bases": bases}
        others = lambda df: df.join(asking, "path", "left_anti").select(*df.columns)
        old = before.links.join(asking, "path", "left_semi").select(*links.columns)
        gone, new = written(old.exceptAll(links), "links"), written(links.exceptAll(old), "links")
        nodes = lambda df: df.join(changed, "path", "left_semi").unionByName(df.where("type = 'directory'"))
        renewed = nodes(before.structs.select("id", "path", "type")).unionByName(nodes(structs.select("id", "path", "type"))).select("id").distinct()
        own = structs.join(renewed, "id", "left_semi")
        contained = reconcile.replace_outbound(before.edges.where("edge_type = 'is_child_of'"), renewed, self._contained(structs, own))
        parts = []
        both = before.structs.select("id", "uid", "parent_uid", "path", "type").unionByName(structs.select("id", "uid", "parent_uid", "path", "type")).distinct()
        for fuzzy, kind in ((False, "depends_on"), (True, "depends_on_fuzzy")):
            change = lambda removed, added, paths, kind=kind: graph.lift_change(before.edges.where(F.col("edge_type") == kind), removed, added, paths)
            parts.append(self._lifted(gone.where(F.col("fuzzy") == fuzzy), both, change, new.where(F.col("fuzzy") == fuzzy), kind))
        edges = parts[0].unionByName(parts[1]).unionByName(contained)
        return {"edges": edges, "links": others(before.links).unionByName(links), "imports": others(before.imports).unionByName(imports), "bases": bases}

    @staticmethod
    def _lifted(links: DataFrame, structs: DataFrame, lift: Callable, more: DataFrame | None = None, kind: str | None = None) -> DataFrame:
        """What ``lift`` makes of links (two sets of them with ``more``) by ids, as edges. Only nodes of the links' files and directories are climbed."""
        if kind is None:
            parts = [Project._lifted(links.where(of), structs, lift, None, k) for of, k in (("not fuzzy", "depends_on"), ("fuzzy", "depends_on_fuzzy"))]
            return parts[0].unionByName(parts[1])
        every = links if more is None else links.unionByName(more)
        files = every.select("path").unionByName(every.select(F.substring_index("target_uid", "#", 1).alias("path"))).distinct()
        nodes = structs.join(files, "path", "left_semi").unionByName(structs.where("type = 'directory'").select(*structs.columns)).select("id", "uid", "parent_uid").distinct()
        ids = nodes.select("uid", "id").distinct()
        paths = graph.root_paths(nodes.join(ids.select(F.col("uid").alias("parent_uid"), F.col("id").alias("parent_id")), "parent_uid", "left").select("id", "parent_id"))
        named = lambda df: df.join(ids.select(F.col("uid").alias("source_uid"), F.col("id").alias("source_id")), "source_uid").join(ids.select(F.col("uid").alias("target_uid"), F.col("id").alias("target_id")), "target_uid").select("source_id", "target_id")
        counts = lift(named(links), paths) if more is None else lift(named(links), named(more), paths)
        return counts.select("source_id", "target_id", F.lit(kind).alias("edge_type"), "n")

    @staticmethod
    def _contained(structs: DataFrame, own: DataFrame | None = None) -> DataFrame:
        """Edges from nodes (all without ``own``) to their parents."""
        parents = structs.select(F.col("uid").alias("parent_uid"), F.col("id").alias("parent_id"))
        nodes = (structs if own is None else own).select("id", "parent_uid").join(parents, "parent_uid")
        return graph.containment_edges(nodes).withColumn("n", F.lit(1).cast("long"))

    def _vectors(self, structs: DataFrame, before: Graph) -> DataFrame:
        """Vectors of what is embedded, and of every directory the mean of the files below it.

        Only texts that the version before did not embed are embedded now.
        """
        if self.embed is None:
            return self.store.empty().vectors
        texts = lambda g: describe.eligible(g).select("id", describe.embedding_text().alias("text"))
        rows, known = texts(structs), texts(before.structs).join(before.vectors.where("vector is not null"), "id")
        kept = known.join(rows, ["id", "text"], "left_semi")
        fresh = self.embed(rows.join(kept, ["id", "text"], "left_anti"))
        own = written(reconcile.replace_vectors(kept.select("id", "vector"), fresh, full=False), "vectors")
        nodes = structs.where("type in ('directory', 'file')").select(F.col("id"), "parent_uid").join(structs.select(F.col("uid").alias("parent_uid"), F.col("id").alias("parent_id")), "parent_uid", "left").select("id", "parent_id")
        files = own.join(structs.where("type = 'file'").select("id"), "id", "left_semi").where("vector is not null")
        means = search.subtree_centroids(nodes, files).join(structs.where("type = 'directory'").select("id"), "id", "left_semi")
        means = means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"].cast("float")).alias("vector"))
        return own.unionByName(means)

    def _held(self, structs: DataFrame, before: Graph) -> DataFrame:
        """``structs`` without ``parsed``, and what files that cannot be parsed whole, as while they are being edited, held before."""
        structs = written(structs, "parsed")
        broken = structs.where("type = 'file' and not parsed").select("path")
        held = before.structs.where("type <> 'directory'").join(broken, "path", "left_semi")
        return reconcile.parsed_wins(structs.drop("parsed"), held)

    def _built(self, structs: DataFrame, before: Graph, lock: DataFrame | None, client: Callable | None = None, changed: DataFrame | None = None) -> Graph:
        """The graph of ``structs``, with what the version before and the lockfile know of unchanged nodes."""
        structs = reconcile.carry_over(structs, before.structs)
        structs = describe.described(structs, lockfile.entries(lock, self.spark), client)
        structs = written(reconcile.first_seen(structs, before.structs), "structs")
        incoming = lockfile.notes(lock, self.spark).join(structs.select("uid", F.col("id").alias("struct_id")), "uid").drop("uid")
        kept = reconcile.cascade_delete(reconcile.prune(before.structs, structs), before.structs, before.edges, before.vectors, before.notes)[3]
        merged = notes.merge(kept, incoming.withColumn("note_id", F.lit(None).cast("long")).select(*kept.columns)) if lock is not None else kept
        # a note that another side has updated keeps the id it has here
        ids = kept.groupBy("struct_id", "author", "date_added").agg(F.min("note_id").alias("_id"))
        merged = written(merged.join(ids, ["struct_id", "author", "date_added"], "left").withColumn("note_id", F.coalesce("_id", "note_id")).drop("_id"), "notes")
        new = notes.numbered(merged.where("note_id is null").drop("note_id"), before.note_high_water)
        all_notes = written(merged.where("note_id is not null").unionByName(new.select(*merged.columns)), "notes")
        high = all_notes.agg(F.max("note_id")).first()[0] or 0
        found = self._edges(structs, before, changed)
        return Graph(structs, vectors=self._vectors(structs, before), notes=all_notes, version=before.version, note_high_water=max(high, before.note_high_water), **found)

    def parse(self, lock_path: str | None = None) -> Graph:
        """Scan the whole tree and commit its graph. Nodes of files that are gone are gone; a file that cannot be
        parsed whole keeps the nodes it had."""
        before = self.store.before()
        files = tree.scan(self.spark, self.root, self.rules, self.language)
        lock = lockfile.read(self.spark, lock_path, LOCK_FORMAT) if lock_path else None
        return self.store.commit(self._built(self._held(self._structs(files, files.select("path")), before), before, lock, self.client))

    def apply(self, changes: DataFrame) -> Graph:
        """Bring the graph up to date with ``changes`` (path, change: added, modified or deleted).

        Only changed files are read and extracted, and only files are resolved whose names can mean something
        else (``resolved`` tells how many); rows of others come from the version before. The result is that of a full parse. A file that is gone counts as deleted; one that cannot be parsed whole
        keeps its nodes with their notes and descriptions. With a client, a first version is committed in which
        the descriptions of changed files are marked as stale, before they are asked for anew.
        """
        before = self.store.load()
        changes = written(changes.select("path", "change").distinct(), "changes")
        files = tree.read(self.root, changes.where("change <> 'deleted'").select("path"), self.rules, self.language)
        gone = changes.select(F.col("path").alias("p"))
        old = before.structs.where("type <> 'directory'")
        below = old.select("path").distinct().join(gone, F.col("path") == F.col("p"), "left_semi")
        folders = changes.where("change = 'deleted'").select(F.concat("path", F.lit("/")).alias("folder"))
        parts = old.select("path").distinct().withColumn("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.concat(F.array_join(F.slice(F.split(F.col("path"), "/"), 1, i), "/"), F.lit("/")))))
        below = below.unionByName(parts.join(folders, "folder", "left_semi").select("path")).distinct()
        kept = written(old.join(below, "path", "left_anti"), "kept")
        fresh = self._held(self._structs(files, files.select("path")), before)
        paths = kept.select("path").distinct().unionByName(files.select("path")).distinct()
        folders = self._structs(files.limit(0), paths).select(*fresh.columns)
        structs = written(reconcile.parsed_wins(fresh.where("type <> 'directory'"), kept).unionByName(folders), "changed")
        touched = written(below.unionByName(fresh.where("type = 'file'").select("path")).distinct(), "touched")
        if self.client is not None:
            first = self._built(structs, before, None, changed=touched)
            first.structs = reconcile.mark_stale(first.structs, gone.withColumnRenamed("p", "path"))
            before.version = self.store.commit(first).version
        return self.store.commit(self._built(structs, before, None, self.client, touched))

    # -- asking -----------------------------------------------------------------------------------

    def _select(self, structs: DataFrame, refs: list[str]) -> DataFrame:
        """Nodes named by ids or uids, each told by its prefix."""
        ids = [r for r in refs if ident.kind_of(r)]
        return structs.where(F.col("id").isin(ids) | F.col("uid").isin([r for r in refs if r not in ids]))

    def _tree(self, structs: DataFrame) -> DataFrame:
        parents = structs.select(F.col("uid").alias("parent_uid"), F.col("id").alias("parent_id"))
        return structs.select("id", "uid", "type", "parent_uid").join(parents, "parent_uid", "left").drop("parent_uid")

    def status(self) -> dict[str, int]:
        """Counts, the version, and the bytes and time (milliseconds) of what the current version's tables hold."""
        g = self.store.load()
        return {r.type: r.n for r in graph.status_counts(g.structs, g.edges, g.notes).collect()} | {"version": g.version} | self.store.size(g)

    def inspect(self, refs: str | list[str], body: bool = False, max_lines: int = 500) -> str:
        """What is known of each node as text; an unknown one gives a line that says so."""
        g, wanted = self.store.load(), parse_refs(refs)
        rows = {r.id: r for r in self._select(g.structs, wanted).collect()}
        known = {x for r in rows.values() for x in (r.id, r.uid)}
        shown = graph.inspect_children(self._tree(g.structs), F.col("id").isin(list(rows)), 1).where("depth = 1")
        children = shown.join(g.structs.select("id", "uid", "signature", "description", "start_line"), "id").orderBy("root_id", "start_line", "uid").collect()
        edges = g.edges.where(F.col("source_id").isin(list(rows)) | F.col("target_id").isin(list(rows)))
        into = {r.id: r.dependencies for r in graph.dependency_strings(edges, g.structs, inbound=True).collect()}
        out = {r.id: r.dependencies for r in graph.dependency_strings(edges, g.structs).collect()}
        log = g.notes.where(F.col("struct_id").isin(list(rows))).orderBy("note_id").collect()
        texts = [self._shown(r, [c for c in children if c.root_id == r.id], into.get(r.id), out.get(r.id), [n for n in log if n.struct_id == r.id], body) for r in sorted(rows.values(), key=lambda r: r.uid)]
        texts += [f"not found: {w}" for w in wanted if w not in known]
        return clipped("\n\n".join(texts), max_lines)

    @staticmethod
    def _shown(r, children: list, into: list | None, out: list | None, log: list, body: bool) -> str:
        span = f" @L{r.start_line}" + (f"-{r.end_line}" if r.end_line != r.start_line else "") if r.start_line else ""
        lines = [f"Filepath: {r.path}"] if r.type in ("class", "method", "field") else []
        lines.append(f"{r.id}{span} | {r.signature or r.uid}")
        if r.description and len(children) != 1:
            lines.append(f"// {r.description}")
        lines += [f"# [{n.note_id}] {n.author} ({(n.date_last_updated or n.date_added)[:10]}): {n.content}" for n in log]
        lines += [f"{sign} {', '.join(deps)}" for sign, deps in (("<", into), (">", out)) if deps]
        for kind, title in (("field", "fields:"), ("method", "methods:"), ("class", "classes:")):
            some = [c for c in children if c.type == kind]
            lines += [title] if some else []
            for c in some:
                lines.append(f"    {c.id} | {c.uid if kind == 'class' else c.signature}")
                if c.description and kind != "field":
                    lines.append(f"        // {c.description}")
        return "\n".join([*lines, f"```\n{r.body}\n```"] if body and r.body else lines)

    def skeleton(self, subpath: str = ".", depth: int = 4, files_only: bool = False, max_lines: int = 500) -> str:
        g = self.store.load()
        rows = graph.skeleton(self._tree(g.structs), F.col("uid") == subpath, depth, files_only)
        rows = rows.join(g.structs.select("id", "uid"), "id").orderBy("sort_path").select("id", "depth", ident.short_uid(F.col("uid")).alias("uid")).collect()
        if not rows:
            raise StoreError(f"nothing at {subpath}")
        return clipped("\n".join(f"{'    ' * r.depth}{r.id} | {r.uid}" for r in rows), max_lines)

    def search(self, text: str, k: int = 5, kind: str | None = None) -> DataFrame:
        """(id, uid, type, distance) of the nodes nearest to a text; the kind is filtered before the search."""
        g = self.store.load()
        query = self.embed(self.spark.createDataFrame([("q", text)], "id string, text string")).first()
        named = g.structs.select("id", "uid", "type")
        rows = g.vectors.where("vector is not null").join(search.of_kind(named, kind) if kind else named, "id")
        return search.nearest(rows, list(query.vector), k).select("id", "uid", "type", "distance")

    def last_updated(self) -> DataFrame:
        """(id, at): when each node, or a note on it, was last changed."""
        g = self.store.load()
        noted = g.notes.groupBy(F.col("struct_id").alias("id")).agg(F.max(F.coalesce("date_last_updated", "date_added")).cast("timestamp").alias("noted"))
        return g.structs.join(noted, "id", "left").select("id", F.greatest("date_last_updated", "noted").alias("at"))

    def subtree(self, path: str) -> DataFrame:
        return self.store.load().structs.where(ident.in_subtree(F.col("path"), path))

    def around(self, uid: str) -> DataFrame:
        return self.store.load().structs.where(ident.near_uid(F.col("uid"), F.col("path"), uid))

    # -- notes ------------------------------------------------------------------------------------

    def note_add(self, ref: str, content: str, author: str = "agent") -> int:
        g = self.store.load()
        node = self._select(g.structs, [ref]).select("id").first()
        if node is None:
            raise StoreError(f"not found: {ref}")
        now = datetime.now().isoformat(timespec="microseconds")
        number = g.note_high_water + 1
        new = self.spark.createDataFrame([(number, node.id, content, author, now, now)], g.notes.schema)
        g.notes, g.note_high_water = notes.add(g.notes, new), number
        self.store.commit(g, ("notes",))
        return number

    def note_edit(self, note_id: int, content: str, author: str = "agent") -> bool:
        g = self.store.load()
        if g.notes.where(F.col("note_id") == note_id).isEmpty():
            return False
        edit = self.spark.createDataFrame([(note_id, content, author, datetime.now().isoformat(timespec="microseconds"))], "note_id long, content string, author string, date_last_updated string")
        g.notes = notes.edit(g.notes, edit)
        self.store.commit(g, ("notes",))
        return True

    def note_remove(self, note_id: int) -> bool:
        g = self.store.load()
        if g.notes.where(F.col("note_id") == note_id).isEmpty():
            return False
        g.notes = notes.remove(g.notes, self.spark.createDataFrame([(note_id,)], "note_id long"))
        self.store.commit(g, ("notes",))
        return True

    def export(self, path: Path, with_vectors: bool = False) -> dict[str, int | bool]:
        """Write the lockfile; how many descriptions and notes it holds, and whether it changed."""
        g = self.store.load()
        entries = lockfile.exported(g.structs, g.vectors if with_vectors else None)
        logs = notes.export(g.notes, g.structs)
        changed = lockfile.write(path, entries, logs, LOCK_FORMAT)
        return {"descriptions": entries.count(), "notes": g.notes.count(), "changed": changed}
