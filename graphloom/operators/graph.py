"""Containment trees and dependency graphs.

Nodes have ``id`` and ``parent_id`` (null at a root); edges have ``source_id`` and ``target_id``. What needs
all ancestors starts from root paths, which take as many joins as the logarithm of the tree's depth; a skeleton
runs once a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.ident import suffixes
from graphloom.functions.scratch import written


def root_paths(nodes: DataFrame) -> DataFrame:
    """(id, path): each node and its ancestors, up to a root or to a parent that is no node.

    Paths double in length with every round - a node's path goes on with that of the node behind its
    end - so a tree of depth d takes log2(d) joins.
    """
    at = written(nodes.select("id", F.array("id").alias("path"), F.col("parent_id").alias("next")), "paths")
    while not at.where("next is not null").isEmpty():
        more = at.select(F.col("id").alias("next"), F.col("path").alias("more"), F.col("next").alias("beyond"))
        longer = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.coalesce("more", F.array("next"))))
        at = written(at.join(more, "next", "left").select("id", longer.alias("path"), F.col("beyond").alias("next")), "paths")
    return at.select("id", "path")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, id, depth) for every node and each of its ancestors, itself (depth 0) included."""
    return root_paths(nodes).select("id", F.posexplode("path").alias("depth", "ancestor_id")).select("ancestor_id", "id", "depth")


def descendants(nodes: DataFrame, root: str) -> DataFrame:
    """Nodes below ``root``, without it."""
    level, out = nodes.where(F.col("parent_id") == root), None
    while not level.isEmpty():
        out = level if out is None else out.unionByName(level)
        level = written(nodes.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(*nodes.columns), "descendants")
    return nodes.limit(0) if out is None else out


def below(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, id): all that lies below each of ``scopes`` (scope). Only their subtrees are gone through, a join a level."""
    level = written(scopes.select("scope", F.col("scope").alias("parent_id")).distinct(), "below")
    out = level.limit(0)
    while not level.isEmpty():
        level = written(nodes.select("id", "parent_id").join(level, "parent_id").select("scope", F.col("id").alias("parent_id")), "below")
        out = out.unionByName(level)
    return out.select("scope", F.col("parent_id").alias("id"))


def _weighed(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Different edges without self-edges, each with the weight n = 1."""
    return edges.select("source_id", "target_id", *by).where("source_id <> target_id").distinct().withColumn("n", F.lit(1).cast("long"))


def _lifts(edges: DataFrame, parents: DataFrame, paths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, target_id, n) of every edge of weight n and of what it implies higher up, not yet added up for each pair.

    Edges are added up by their ends' parents (id, up) first: only these sums, far fewer, are joined to
    ``paths`` (id, path), which need hold parents alone. An end that is no node, or has no parent, implies nothing.
    """
    up = lambda end: parents.select(F.col("id").alias(end), F.col("up").alias(f"{end}_up"))
    higher = edges.join(up("source_id"), "source_id").drop("source_id").join(up("target_id"), "target_id").where("source_id_up <> target_id_up")
    higher = higher.groupBy(F.col("source_id_up").alias("source_id"), F.col("target_id_up").alias("target_id"), *by).agg(F.sum("n").alias("n"))
    ends = [paths.select(F.col("id").alias(k), F.col("path").alias(f"{k}s")) for k in ("source_id", "target_id")]
    alone = lambda k: F.coalesce(f"{k}s", F.array(k)).alias(f"{k}s")  # noqa: E731 - an end that is no node
    rows = higher.join(ends[0], "source_id", "left").join(ends[1], "target_id", "left").select(alone("source_id"), alone("target_id"), *by, "n")
    # once both parents are one node, so are all above
    pairs = F.filter(F.arrays_zip("source_ids", "target_ids"), lambda x: x["source_ids"] != x["target_ids"])
    rows = rows.select(F.explode(pairs).alias("x"), *by, "n").select(F.col("x.source_ids").alias("source_id"), F.col("x.target_ids").alias("target_id"), *by, "n")
    return edges.unionByName(rows)


def _parents(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, up) of nodes with a parent, and the root paths of these parents: tables whose sizes Spark knows, so small ones are broadcast."""
    parents = paths.where("size(path) > 1").select("id", F.get("path", F.lit(1)).alias("up"))
    inner = written(parents.select(F.col("up").alias("id")).distinct(), "parents")
    return parents, written(paths.join(inner, "id", "left_semi"), "parents")


def lift_counts(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(source_id, target_id, n): ``edges`` and what they imply higher up, and how many of them imply each.

    An edge s -> t implies parent(s) -> parent(t) while both parents exist and differ, again and again;
    ``paths`` (id, path) are the nodes' root paths. Self-edges are left out.
    """
    return _lifts(_weighed(edges), *_parents(paths)).groupBy("source_id", "target_id").agg(F.sum("n").alias("n"))


def lift_change(counts: DataFrame, removed: DataFrame, added: DataFrame, paths: DataFrame) -> DataFrame:
    """``counts`` after some of its edges were removed and others added: only what these imply is counted anew,
    and an edge goes with the last one that implies it.

    ``paths`` are those of the ends of both; ends keep their place in the tree.
    """
    changed = _weighed(added).unionByName(_weighed(removed).withColumn("n", -F.col("n")))
    both = counts.select("source_id", "target_id", "n").unionByName(_lifts(changed, *_parents(paths)))
    return both.groupBy("source_id", "target_id").agg(F.sum("n").alias("n")).where("n > 0")


def lift_edges(edges: DataFrame, nodes: DataFrame, *by: str) -> DataFrame:
    """``edges`` and what they imply higher up, without self-edges; those that differ in the columns ``by`` apart."""
    parents = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("up"))
    inner = nodes.select("id", "parent_id").join(parents.select(F.col("up").alias("id")).distinct(), "id", "left_semi")
    return _lifts(_weighed(edges, by), parents, root_paths(inner), by).select("source_id", "target_id", *by).distinct()


def containment_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("is_child_of").alias("edge_type"))


def dependency_strings(edges: DataFrame, nodes: DataFrame, inbound: bool = False) -> DataFrame:
    """(id, dependencies): what a node depends on as sorted ``id|uid``, ``~`` first where the edge is fuzzy.

    edges needs edge_type; ``inbound`` gives what depends on the node. Derived from edges, never stored.
    """
    mine, other = ("target_id", "source_id") if inbound else ("source_id", "target_id")
    named = edges.where(F.col("edge_type").isin("depends_on", "depends_on_fuzzy")).join(nodes.select(F.col("id").alias(other), "uid"), other)
    text = F.concat(F.when(F.col("edge_type") == "depends_on_fuzzy", "~").otherwise(""), F.concat_ws("|", F.col(other), "uid"))
    return named.groupBy(F.col(mine).alias("id")).agg(F.array_sort(F.collect_set(text)).alias("dependencies"))


def impact_score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, impact): inbound edges, exact and fuzzy, and how many kinds of children a node has."""
    into = edges.where(F.col("edge_type").isin("depends_on", "depends_on_fuzzy")).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("into"))
    kinds = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count_distinct("type").alias("kinds"))
    score = F.coalesce("into", F.lit(0)) + F.coalesce("kinds", F.lit(0))
    return nodes.select("id").join(into, "id", "left").join(kinds, "id", "left").select("id", score.cast("long").alias("impact"))


def type_counts(nodes: DataFrame) -> DataFrame:
    """(type, n): how many nodes there are of each kind."""
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def status_counts(nodes: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(type, n): nodes of each kind, and all ``edges`` and ``notes``."""
    count = lambda df, name: df.agg(F.lit(name).alias("type"), F.count("*").alias("n"))
    return type_counts(nodes).unionByName(count(edges, "edges")).unionByName(count(notes, "notes"))


#: Order of children in a skeleton by kind; members of classes are not shown.
SKELETON_ORDER = ("file", "directory", "class", "method")


def skeleton(nodes: DataFrame, roots: Column, depth: int, files_only: bool = False) -> DataFrame:
    """The tree below the nodes that ``roots`` selects, ``depth`` levels deep: root_id, id, depth, sort_path.

    Children stand as files, directories, classes, and free functions of a file, by uid. Classes are
    not expanded. nodes needs uid and type. sort_path orders the rows of a root as they are shown.
    """
    kinds = SKELETON_ORDER[:2] if files_only else SKELETON_ORDER
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("type"))
    children = nodes.where(F.col("type").isin(*kinds) & (F.col("id") != F.col("parent_id"))).select("id", "parent_id", "type", "uid", F.format_string("%d:%s", rank, F.col("uid")).alias("step"))
    level = nodes.where(roots).select(F.col("id").alias("root_id"), "id", "type", F.lit(0).alias("depth"), F.array("uid").alias("sort_path"))
    out = level
    for _ in range(depth):
        open_ = level.where(F.col("type").isin("directory", "file")).select("root_id", F.col("id").alias("parent_id"), F.col("type").alias("parent_type"), "depth", "sort_path")
        level = children.join(open_, "parent_id").where("type <> 'method' or parent_type = 'file'")
        level = level.select("root_id", "id", "type", (F.col("depth") + 1).alias("depth"), F.array_append("sort_path", F.col("step")).alias("sort_path"))
        level = written(level, "skeleton")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def inspect_children(nodes: DataFrame, roots: Column, depth: int = 2) -> DataFrame:
    """root_id, id, depth and kind of the nodes shown with each root: ``depth`` levels of children; methods and fields have none."""
    level = nodes.where(roots).select(F.col("id").alias("root_id"), "id", "type", F.lit(0).alias("depth"))
    out = level
    for _ in range(depth):
        open_ = level.where("depth = 0 or type not in ('method', 'field')").select("root_id", F.col("id").alias("parent_id"), "depth")
        level = nodes.join(open_, "parent_id").where("id <> parent_id").select("root_id", "id", "type", (F.col("depth") + 1).alias("depth"))
        out = out.unionByName(level)
    return out


def first_by(candidates: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first candidate of each key: the outcome of a cascade of tagged joins.

    ``min`` of a struct combines on the map side, so a key with a third of the candidates does not meet in
    one task as it would in a window.
    """
    rest = [c for c in candidates.columns if c not in (*keys, *order)]
    return candidates.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*keys, "x.*")


def unique_names(nodes: DataFrame, name: str = "name", uid: str = "uid") -> DataFrame:
    """(name, uid) of the names that one node alone has."""
    return nodes.groupBy(name).agg(F.count("*").alias("n"), F.min(uid).alias(uid)).where("n = 1").select(name, uid)


def suffix_matches(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (candidate, uid) where the uid is the candidate or ends with ``/`` and it.

    Every uid stands once for itself and once for each of its path suffixes, as many as it is deep, so the
    whole candidate is the key of an equi-join: names that many files have, alone, gather nothing. A pair stands
    once, whatever number of nodes has the uid.
    """
    ends = nodes.select("uid", F.explode(F.array_append(suffixes(F.col("uid")), F.col("uid"))).alias("candidate"))
    return candidates.select("candidate").distinct().join(ends, "candidate").select("candidate", "uid").distinct()


def ring(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """The last ``cap`` rows of each key by ``order``."""
    newest = W.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= cap).drop("_nth")
