"""From names to edges: every rule is an equi-join that tags its hits, and the first hit by tag stands.

Nothing is looked up row by row: imports, types, members and calls are tables, cascades are unions with
one aggregate, and inheritance is a loop as long as the longest chain of bases, over the scopes that
calls ask for.

After a change only the files are resolved whose answers can differ: ``affected`` finds them through an
inverted index from what could be meant - path suffixes and names of nodes that came or went - to the
import candidates that ask for it, and through the imports and bases of the version before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ident import suffixes
from graphloom.functions.scratch import written
from graphloom.operators.extract import calls as calls_of
from graphloom.operators.extract import import_candidates
from graphloom.operators.graph import below, containment_edges, first_by, lift_edges, suffix_matches, unique_names

#: Languages whose calls match by number of arguments as well (fixed values).
STRICT_ARITY = ("java",)


def simple_name(token: Column) -> Column:
    """A type without generics, arrays and what stands before its last dot."""
    return F.substring_index(F.trim(F.substring_index(F.substring_index(token, "<", 1), "[", 1)), ".", -1)


def bound_name(candidate: Column) -> Column:
    """The name that an import candidate binds."""
    tail = F.when(candidate.contains("#"), F.substring_index(candidate, "#", -1)).otherwise(F.substring_index(candidate, ".", -1))
    return F.substring_index(tail, "(", 1)


def resolve_candidates(candidates: DataFrame, structs: DataFrame) -> DataFrame:
    """(candidate, target): by uid, else by path suffix, else by a name that is unique in the project
    provided that the module it is imported from is one of the project's files."""
    wanted = candidates.select("candidate").distinct()
    modules = wanted.where("candidate like '%#%'").select(F.regexp_replace("candidate", "#[^#]*$", "").alias("candidate")).distinct()
    asked = wanted.unionByName(modules).distinct()
    hits = suffix_matches(asked, structs.select("uid")).withColumn("rank", (F.col("uid") != F.col("candidate")).cast("int"))
    found = first_by(hits.select("candidate", "rank", F.col("uid").alias("target")), ["candidate"], "rank", "target").select("candidate", "target")
    found = written(found, "candidates")
    left = wanted.where("candidate like '%#%'").join(found, "candidate", "left_anti")
    left = left.select("candidate", F.regexp_replace("candidate", "#[^#]*$", "").alias("module"), bound_name(F.col("candidate")).alias("name"))
    left = left.join(found.select(F.col("candidate").alias("module")), "module", "left_semi")
    named = left.join(unique_names(structs).withColumnRenamed("uid", "target"), "name").select("candidate", "target")
    return found.join(wanted, "candidate", "left_semi").unionByName(named)


@dataclass
class Resolver:
    """The tables that rules look into, made once for a graph. structs is the output of ``extract``.

    With ``asking`` (path) only what these files ask for is resolved; the bases of other files' classes
    then come from ``known_bases`` (uid, ord, base).
    """

    structs: DataFrame
    asking: DataFrame | None = None
    known_bases: DataFrame | None = None

    def __post_init__(self) -> None:
        s = self.structs
        self.nodes = s.select("uid", "name", "type", "parent_uid", "arity", "lang", F.coalesce("field_type", F.lit("")).alias("field_type"), "inherits", "ord", F.substring_index("uid", "#", 1).alias("file_uid"))
        self.askers = s if self.asking is None else s.join(self.asking, "path", "left_semi").select(*s.columns)
        self.own = self.nodes if self.asking is None else self.nodes.join(self.asking.withColumnRenamed("path", "file_uid"), "file_uid", "left_semi").select(*self.nodes.columns)
        raw = written(import_candidates(self.askers), "imports")
        resolved = resolve_candidates(raw, s)
        self.imports = written(raw.join(resolved, "candidate").withColumn("bound", bound_name(F.col("candidate"))), "imports")
        tree = s.select(F.col("uid").alias("id"), F.col("parent_uid").alias("parent_id"))
        self.below = below(tree, self.imports.where("is_wildcard").select(F.col("target").alias("scope"))).withColumnRenamed("id", "uid")  # wildcards alone look there
        self.methods = self.nodes.where("type = 'method'").select(F.col("uid").alias("method"), F.col("name"), F.col("arity").alias("method_arity"), "parent_uid")

    def types(self, refs: DataFrame) -> DataFrame:
        """(ref, target) for refs (ref, file_uid, type_name): by uid, by a class of that name in the same
        file, else by the file's imports in order - a bound name, or a class below a wildcard's scope."""
        refs = refs.where("type_name <> ''").withColumn("simple", simple_name(F.col("type_name")))
        classes = self.nodes.where("type = 'class'").select(F.col("name").alias("simple"), F.col("uid").alias("target"), "file_uid")
        own = refs.join(self.nodes.select(F.col("uid").alias("type_name"), F.col("uid").alias("target")), "type_name").select("ref", F.lit(0).alias("rank"), F.lit(0).alias("ord"), "target")
        same = refs.join(classes, ["simple", "file_uid"]).select("ref", F.lit(1).alias("rank"), F.lit(0).alias("ord"), "target")
        named = refs.join(self.imports.where("not is_wildcard").select("file_uid", F.col("bound").alias("simple"), "ord", "target"), ["file_uid", "simple"]).select("ref", F.lit(2).alias("rank"), "ord", "target")
        scopes = self.imports.where("is_wildcard").select("file_uid", "ord", F.col("target").alias("scope"))
        opened = scopes.join(self.below, "scope").join(classes.select(F.col("target").alias("uid"), "simple"), "uid").select("file_uid", "simple", "ord", F.col("uid").alias("target"))
        wild = refs.join(opened, ["file_uid", "simple"]).select("ref", F.lit(2).alias("rank"), "ord", "target")
        return first_by(own.unionByName(same).unionByName(named).unionByName(wild), ["ref"], "rank", "ord", "target").select("ref", "target")

    def bases(self) -> DataFrame:
        """(uid, ord, base) of each asking class's resolved bases, in order."""
        refs = self.own.where("type = 'class'").select("uid", "file_uid", F.posexplode("inherits").alias("ord", "type_name"))
        refs = refs.withColumn("ref", F.struct("uid", "ord"))
        return self.types(refs.select("ref", "file_uid", "type_name")).select("ref.uid", "ref.ord", F.col("target").alias("base"))

    def inherited(self, bases: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
        """(scope, name, method, method_arity, path): the methods that each node has or inherits. path
        orders them as a search does that goes through the bases in order, depth first; a chain stops
        where it comes back to a class.

        ``wanted`` (scope, name) bounds the work: only these scopes' bases are followed, and only methods of
        these names are given.
        """
        owners = self.nodes.where("type in ('class', 'file')").select(F.col("uid").alias("scope"))
        if wanted is not None:
            owners = owners.join(wanted.select("scope").distinct(), "scope", "left_semi")
        level = owners.select("scope", F.col("scope").alias("at"), F.array().cast("array<int>").alias("path"), F.array("scope").alias("seen"))
        out = level
        while True:
            level = written(
                level.join(bases.select(F.col("uid").alias("at"), "ord", "base"), "at").where(~F.array_contains("seen", F.col("base"))).select("scope", F.col("base").alias("at"), F.array_append("path", F.col("ord")).alias("path"), F.array_append("seen", F.col("base")).alias("seen")), "bases"
            )
            if level.isEmpty():
                break
            out = out.unionByName(level)
        if wanted is not None:
            out = out.join(wanted.distinct(), "scope")
        methods = self.methods.withColumnRenamed("parent_uid", "at")
        return out.join(methods, "at" if wanted is None else ["at", "name"]).select("scope", "name", "method", "method_arity", "path")

    def all_bases(self) -> DataFrame:
        """Bases of every class: those of asking files resolved, the others as they are known."""
        own = self.bases()
        if self.known_bases is None:
            return own
        others = self.known_bases.join(self.own.select("uid"), "uid", "left_anti").join(self.nodes.select("uid"), "uid", "left_semi")
        return own.unionByName(others.select("uid", "ord", "base"))

    def links(self, bases: DataFrame) -> DataFrame:
        """(s, t, fuzzy), by uid: what all rules find for the asking files, not lifted."""
        classes = self.own.where("type = 'class'")
        by_import = classes.select("uid", "file_uid").join(self.imports.where("not is_wildcard").select("file_uid", "target"), "file_uid").select(F.col("uid").alias("s"), F.col("target").alias("t"))
        by_base = bases.join(classes.select("uid"), "uid", "left_semi").select(F.col("uid").alias("s"), F.col("base").alias("t"))
        fields = self.own.where("type = 'field'").join(classes.select(F.col("uid").alias("parent_uid")), "parent_uid", "left_semi")
        refs = fields.select(F.struct("parent_uid", "uid").alias("ref"), "file_uid", F.col("field_type").alias("type_name"))
        by_field = self.types(refs).select(F.col("ref.parent_uid").alias("s"), F.col("target").alias("t"))
        exact = by_import.unionByName(by_base).unionByName(by_field).withColumn("fuzzy", F.lit(False))
        return exact.unionByName(self.calls(bases)).where("s <> t").distinct()

    def edges(self) -> DataFrame:
        """(source_id, target_id, edge_type) of all rules, lifted through the tree, and the tree itself; by uid."""
        links = written(self.links(written(self.all_bases(), "bases")), "links")
        tree = self.nodes.select(F.col("uid").alias("id"), F.col("parent_uid").alias("parent_id"))
        kind = F.when(F.col("fuzzy"), "depends_on_fuzzy").otherwise("depends_on").alias("edge_type")
        lifted = lift_edges(links.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), kind), tree, "edge_type")
        inside = tree.join(tree.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
        return lifted.unionByName(containment_edges(inside))

    def _scopes(self, plain: DataFrame, bases: DataFrame) -> DataFrame:
        """Where the methods of a call's name are looked for: its file, what that imports, the bases of the class around it."""
        scope = plain.select("ref", "file_uid", "parent_uid", "name", "arity", "receiver", "strict")
        parents = scope.select("ref", F.col("file_uid").alias("scope"), F.lit(False).alias("is_wildcard"))
        parents = parents.unionByName(scope.join(self.imports.select("file_uid", F.col("target").alias("scope"), "is_wildcard"), "file_uid").select("ref", "scope", "is_wildcard"))
        parents = parents.unionByName(scope.join(bases.select(F.col("uid").alias("parent_uid"), F.col("base").alias("scope")), "parent_uid").select("ref", "scope", F.lit(False).alias("is_wildcard"))).distinct()
        return parents.join(scope.select("ref", "name", "arity", "strict", "receiver"), "ref")

    def calls(self, bases: DataFrame) -> DataFrame:
        """(s, t, fuzzy) of each call, by the first rule that finds something:

        a creation names a type; a sibling of that name; a method of the receiver's type, inherited ones
        included; the methods of that name in the file, its imports and the bases - one is exact, of
        several one whose class's name holds the receiver, else all are fuzzy; none: the name as a type.
        """
        nodes = self.nodes
        me = nodes.where("type = 'method'").select(F.col("uid").alias("caller"), "parent_uid", "file_uid", "lang")
        owner = nodes.select(F.col("uid").alias("parent_uid"), (F.col("type") == "class").alias("in_class"))
        call = calls_of(self.askers).withColumnRenamed("caller_uid", "caller").join(me, "caller").join(owner, "parent_uid", "left")
        strict = F.col("lang").isin(*STRICT_ARITY)
        call = written(call.withColumns({"ref": F.struct("caller", "ord"), "strict": strict, "first": F.substring_index("receiver", ".", 1)}), "calls")

        made = self.types(call.where("is_creation").select("ref", "file_uid", F.col("name").alias("type_name"))).select("ref", F.col("target").alias("t"))
        plain = call.where("not is_creation")

        local = plain.where("strict or receiver is null or first in ('self', 'cls')")
        siblings = nodes.select("parent_uid", "name", F.coalesce("arity", F.lit(-1)).alias("its"), F.col("uid").alias("t"))
        local = local.join(siblings, ["parent_uid", "name"]).where("not strict or its = arity").groupBy("ref").agg(F.min("t").alias("t"))
        local = written(local, "local")
        plain = plain.join(local.select("ref"), "ref", "left_anti")

        # what a receiver is: self, a field of self, a field or global beside the method, or an imported module
        selves = plain.where("not strict and in_class and receiver in ('self', 'cls')").select("ref", "file_uid", F.col("parent_uid").alias("type_name"), F.lit(0).alias("rank"))
        dotted = "not strict and first in ('self', 'cls')"
        field = F.when(F.expr(dotted), F.substring_index(F.regexp_replace("receiver", r"^(self|cls)\.", ""), ".", 1)).otherwise(F.col("receiver"))
        typed = nodes.where("type = 'field'").select("parent_uid", F.col("name").alias("field"), "field_type")
        ofs = plain.where(f"receiver is not null and receiver not in ('self', 'cls') and (in_class or not ({dotted}))").withColumn("field", field).join(typed, ["parent_uid", "field"]).select("ref", "file_uid", F.col("field_type").alias("type_name"), F.lit(0).alias("rank"))
        stem = F.regexp_extract("candidate", r"([^/]+?)(\.[^./]*)?$", 1)
        modules = self.imports.where("not is_wildcard and candidate not like '%#%'").select("file_uid", stem.alias("receiver"), F.col("target").alias("type_name"), (F.col("ord") + 1).alias("rank"))
        mods = plain.where(f"receiver is not null and not ({dotted})").join(modules, ["file_uid", "receiver"]).select("ref", "file_uid", "type_name", "rank")
        received = first_by(selves.unionByName(ofs).unionByName(mods), ["ref"], "rank", "type_name", "file_uid")
        typed_calls = written(self.types(received.select("ref", "file_uid", "type_name")).select("ref", F.col("target").alias("scope")), "typed")
        asked = self._scopes(plain, bases).where("not is_wildcard").select("scope", "name").unionByName(plain.join(typed_calls, "ref").select("scope", "name"))
        owned = written(self.inherited(bases, asked), "inherited")
        hits = plain.join(typed_calls, "ref").join(owned, ["scope", "name"]).where("not strict or method_arity = arity")
        by_type = written(first_by(hits.select("ref", "path", "method"), ["ref"], "path", "method").select("ref", F.col("method").alias("t")), "received")
        plain = plain.join(by_type.select("ref"), "ref", "left_anti")

        asked = self._scopes(plain, bases)
        direct = asked.where("not is_wildcard").join(owned, ["scope", "name"]).where("not strict or method_arity = arity")
        nearest = direct.groupBy("ref", "scope").agg(F.min("path").alias("path"))
        direct = direct.join(nearest, ["ref", "scope", "path"]).select("ref", "scope", "receiver", "method")
        inside = self.methods.select(F.col("method").alias("uid"), "name", "method_arity").join(self.below, "uid").select("scope", "name", "method_arity", F.col("uid").alias("method"))
        wild = asked.where("is_wildcard").join(inside, ["scope", "name"]).where("not strict or method_arity = arity").select("ref", "scope", "receiver", "method")
        found = direct.unionByName(wild)
        homes = self.methods.select("method", F.col("parent_uid").alias("uid")).join(nodes.select("uid", F.col("name").alias("home")), "uid").select("method", "home")
        found = written(found.join(homes, "method", "left").withColumn("fits", F.coalesce(F.lower("home").contains(F.lower("receiver")), F.lit(False))), "found")
        counts = found.groupBy("ref").agg(F.count("*").alias("n"), F.count_if("fits").alias("fitting"))
        judged = found.join(counts, "ref").where("n = 1 or fitting <> 1 or fits").select("ref", F.col("method").alias("t"), F.expr("n > 1 and fitting <> 1").alias("fuzzy"))
        none = plain.join(found.select("ref").distinct(), "ref", "left_anti")
        by_name = self.types(none.select("ref", "file_uid", F.col("name").alias("type_name"))).select("ref", F.col("target").alias("t"))

        exact = made.unionByName(local).unionByName(by_type).unionByName(by_name).withColumn("fuzzy", F.lit(False))
        return exact.unionByName(judged).select(F.col("ref.caller").alias("s"), "t", "fuzzy").where("s <> t").distinct()


def affected(changed: DataFrame, before: DataFrame, after: DataFrame, imports: DataFrame, bases: DataFrame) -> DataFrame:
    """(path) of the files whose names can mean something else than before.

    ``changed`` (path) are the files that came, went or differ; before and after are the nodes of both
    versions, imports (path, target, is_wildcard) and bases (path, base) are those resolved before.

    1. Nodes that came or went: a file is asked again if one of its import candidates, or the module of one,
       is such a uid or the end of it, or binds the name of such a node (names can be or become unique).
    2. Where the methods of classes can differ: the changed files and those of 1, then, again and again, files
       with a class whose base lies there, or with bases and a wildcard import that reaches there.
    3. Files that import something from any of these.
    """
    of = lambda df: df.select("uid", "name")
    inside = lambda df: df.join(changed, "path", "left_semi").unionByName(df.where("type = 'directory'"), allowMissingColumns=True)
    old, new = of(inside(before.select("uid", "name", "type", "path"))), of(inside(after.select("uid", "name", "type", "path")))
    moved = written(old.join(new, "uid", "left_anti").unionByName(new.join(old, "uid", "left_anti")).distinct(), "moved")
    candidates = import_candidates(after).select(F.col("file_uid").alias("path"), "candidate")
    module = F.regexp_replace("candidate", "#[^#]*$", "")
    keys = moved.select(F.explode(F.array_append(suffixes(F.col("uid")), F.col("uid"))).alias("key")).distinct()
    asked = candidates.select("path", F.explode(F.array_distinct(F.array("candidate", module))).alias("key")).join(keys, "key", "left_semi")
    named = candidates.where("candidate like '%#%'").select("path", bound_name(F.col("candidate")).alias("name")).join(moved.select("name"), "name", "left_semi")
    reached = written(changed.select("path").unionByName(asked.select("path")).unionByName(named.select("path")).distinct(), "reached")

    # where an import can be followed to: its target's file, or for wildcards all that lies below
    home = F.substring_index("target", "#", 1)
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/"))), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(F.split(F.col("path"), "/"), 1, i), "/")))

    def importing(there: DataFrame, wild: bool) -> DataFrame:
        plain = imports.where("is_wildcard" if wild else "true").select("path", home.alias("at")).join(there.select(F.col("path").alias("at")), "at", "left_semi").select("path")
        opened = imports.where("is_wildcard").select("path", F.col("target").alias("at")).join(there.select(F.explode(above).alias("at")).distinct(), "at", "left_semi").select("path")
        return plain.unionByName(opened)

    deriving = after.where("type = 'class' and size(inherits) > 0").select("path").distinct()
    frontier = reached
    while True:
        by_base = bases.select("path", F.substring_index("base", "#", 1).alias("at")).join(frontier.select(F.col("path").alias("at")), "at", "left_semi").select("path")
        by_wild = importing(frontier, wild=True).join(deriving, "path", "left_semi")
        frontier = written(by_base.unionByName(by_wild).distinct().join(reached, "path", "left_anti"), "reached")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.unionByName(importing(reached, wild=False)).distinct()
