"""Graph versions as Parquet tables in parts, one part a range of paths.

A commit writes the parts whose rows differ from those of the version before, and then one manifest file
that tells of each table where its parts lie. So readers see a version whole or not at all, an edit of a
file rewrites the parts that hold its path, a note costs its own table only, and plans that read the version
before keep their files. Whether a part differs is told by the number and the hashes of its rows, so
a writer need not say what it touched. Ranges are split where more than ``PART_ROWS`` nodes have gathered.

Commits are atomic: the manifest of a version is created only if there is none, so of two writers that
start from one version one wins, and what the other has written is never read. Parts lie in folders of
their own name, so writers do not meet there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import files, scratch
from graphloom.operators.extract import NODE

FORMAT_VERSION = 2
#: Versions from which older stores cannot be read.
BREAKING = (1, 2)
#: The format of what lockfiles hold.
LOCK_FORMAT = 1
#: A range of paths is split once it has twice so many nodes.
PART_ROWS = 200_000

SCHEMAS = {
    "structs": f"id string, {NODE}, description string, date_added timestamp, date_last_updated timestamp",
    "edges": "source_id string, target_id string, edge_type string, n long",
    "vectors": "id string, vector array<float>",
    "notes": "note_id long, struct_id string, content string, author string, date_added string, date_last_updated string",
    "links": "path string, source_uid string, target_uid string, fuzzy boolean",
    "imports": "path string, ord int, candidate string, target string, is_wildcard boolean",
    "bases": "path string, uid string, ord int, base string",
}
#: Column that tells a row's node, for tables without a path; notes are one part.
_NODE_OF = {"edges": "source_id", "vectors": "id"}


class StoreError(Exception):
    """There is no store, or this code cannot read it."""


@dataclass
class Graph:
    structs: DataFrame
    edges: DataFrame
    vectors: DataFrame
    notes: DataFrame
    version: int = 0
    note_high_water: int = 0
    #: The version in which something of each table was last written.
    written_in: dict[str, int] = field(default_factory=dict)
    #: Edges between nodes before they are lifted (n of ``edges`` is how many of them imply an edge), resolved imports and bases, each with the path of the file that they come from.
    links: DataFrame | None = None
    imports: DataFrame | None = None
    bases: DataFrame | None = None


@dataclass(frozen=True)
class Part:
    """Rows of a table whose paths begin at ``low``; ``n`` rows with this digest, written by ``version``."""

    low: str
    folder: str
    n: int
    digest: str
    version: int


def range_of(path: Column, lows: list[str]) -> Column:
    """The number of the range that holds a path; ranges begin at ``lows``, the first at the empty path."""
    return F.size(F.filter(F.array(*map(F.lit, lows[1:])), lambda x: x <= path)) if len(lows) > 1 else F.lit(0)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifests --------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(x[:-5]) for x in files.names(self.spark, f"{self.path}/manifest") if x.endswith(".json") and x[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        return json.loads(files.read_text(self.spark, self._named(known[-1] if version is None else version)))

    def _named(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    @staticmethod
    def _parts(manifest: dict | None) -> dict[str, list[Part]]:
        return {n: [Part(*x) for x in (manifest or {}).get("parts", {}).get(n, [])] for n in SCHEMAS}

    def exists(self) -> bool:
        return bool(self.versions())

    def empty(self) -> Graph:
        none = {n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
        return Graph(none["structs"], none["edges"], none["vectors"], none["notes"], links=none["links"], imports=none["imports"], bases=none["bases"])

    def load(self, version: int | None = None) -> Graph:
        """The last version, or the one asked for."""
        last = self._manifest(version)
        if last is None:
            raise StoreError(f"no graph at {self.path}; parse the project first" if version is None else f"no version {version} at {self.path}")
        if last["format_version"] > FORMAT_VERSION or any(last["format_version"] < b <= FORMAT_VERSION for b in BREAKING):
            raise StoreError(f"the graph at {self.path} has format {last['format_version']}, this code reads {FORMAT_VERSION}")
        parts, tables = self._parts(last), {}
        for n, schema in SCHEMAS.items():
            folders = [f"{self.path}/{p.folder}" for p in parts[n]]
            tables[n] = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        written_in = {n: max((p.version for p in parts[n]), default=last["tables"][n]) for n in SCHEMAS}
        return Graph(**tables, version=last["version"], note_high_water=last["note_high_water"], written_in=written_in)

    def before(self) -> Graph:
        """The current version to build upon; an empty one where there is none or it cannot be read."""
        try:
            return self.load()
        except StoreError:
            graph = self.empty()
            graph.version = max(self.versions(), default=0)
            return graph

    def size(self, graph: Graph) -> dict[str, int]:
        """bytes of the files of ``graph`` and when (milliseconds) the last of them was written."""
        found = [f for own in self._parts(self._manifest(graph.version)).values() for p in own for f in scratch.listed(self.spark, f"{self.path}/{p.folder}")]
        return {"bytes": sum(n for n, _ in found), "updated": max((t for _, t in found), default=0)}

    def clean(self) -> bool:
        """Delete a store, on any file system that Spark reads; whether there was one."""
        return self.exists() and scratch.delete(self.spark, self.path)

    # -- committing -------------------------------------------------------------------------------

    def _lows(self, structs: DataFrame, lows: list[str]) -> list[str]:
        """Where ranges of paths begin, those with too many nodes split."""
        rows = structs.select(F.coalesce("path", F.lit("")).alias("path")).withColumn("k", range_of(F.col("path"), lows))
        full = {r.k: r.n for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect() if r.n > 2 * PART_ROWS}  # a row a range
        new = set(lows)
        for k, n in full.items():
            pieces = rows.where(F.col("k") == k).repartitionByRange(-(-n // PART_ROWS), "path")
            new |= set(sorted(r.low for r in pieces.groupBy(F.spark_partition_id().alias("p")).agg(F.min("path").alias("low")).collect())[1:])  # a row a piece
        return sorted(new)

    def _rows(self, graph: Graph, name: str, lows: list[str]) -> DataFrame:
        """A table with the range of each row, as ``part``."""
        columns = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]
        df = getattr(graph, name)
        if name in _NODE_OF:
            paths = graph.structs.select(F.col("id").alias(_NODE_OF[name]), F.col("path").alias("_path"))
            df = df.select(*columns).join(paths, _NODE_OF[name], "left")
        elif name != "notes":
            df = df.select(*columns).withColumn("_path", F.col("path"))
        else:
            return df.select(*columns, F.lit(0).alias("part"))
        return df.select(*columns, range_of(F.coalesce("_path", F.lit("")), lows).alias("part"))

    def _written(self, rows: DataFrame, name: str, lows: list[str], before: list[Part], version: int) -> tuple[list[Part], str | None]:
        """Parts of a table, the unchanged ones where they are, and the folder of the others."""
        columns = [c for c in rows.columns if c != "part"]
        hashed = F.xxhash64(*columns)
        digests = rows.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(hashed).alias("x"), F.sum(hashed.cast("decimal(20,0)")).alias("s")).collect()  # a row a part
        known = {p.low: p for p in before}
        now = {r.part: Part(lows[r.part], "", r.n, f"{r.x}:{r.s}", version) for r in digests}
        kept = {k: known[p.low] for k, p in now.items() if p.low in known and (known[p.low].n, known[p.low].digest) == (p.n, p.digest)}
        new = sorted(now.keys() - kept.keys())
        folder = f"data/{name}-{version}-{uuid.uuid4().hex[:12]}" if new else None
        if new:
            order = ("path", "uid") if name == "structs" else ("path",) if "path" in columns else columns[:1]
            own = rows.where(F.col("part").isin(new))
            own = own.repartitionByRange(len(new), "part", *order) if len(new) > 1 else own.coalesce(1)
            own.sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{self.path}/{folder}")
        out = {k: kept.get(k) or Part(p.low, f"{folder}/part={k}", p.n, p.digest, version) for k, p in now.items()}
        return [out[k] for k in sorted(out)], folder

    def commit(self, graph: Graph, changed: tuple[str, ...] = tuple(SCHEMAS)) -> Graph:
        """Write what differs in the ``changed`` tables of ``graph`` as the version after its own; the others stay as they are.

        Nodes are sorted by path, so path filters skip row groups. Where another writer commits first, this one's
        version never comes to be.
        """
        last, version = self._manifest(), graph.version + 1
        self._check(last["version"] if last else 0, graph)
        usable = last if last and last["format_version"] == FORMAT_VERSION else None
        before, lows = self._parts(usable), (usable or {}).get("lows", [""])
        if "structs" in changed:
            lows = self._lows(graph.structs, lows)
        parts, folders = dict(before), []
        for name in changed:
            if getattr(graph, name) is None:
                parts[name] = []
                continue
            rows = scratch.written(self._rows(graph, name, lows), f"commit-{name}")
            parts[name], folder = self._written(rows, name, lows, before[name], version)
            scratch.discard(rows)
            folders += [folder] if folder else []
        at = {n: version if usable is None or parts[n] != before[n] else usable["tables"][n] for n in SCHEMAS}
        manifest = {"version": version, "format_version": FORMAT_VERSION, "note_high_water": graph.note_high_water, "lows": lows, "tables": at, "parts": {n: [list(vars(p).values()) for p in own] for n, own in parts.items()}}
        if not files.create_new(self.spark, self._named(version), json.dumps(manifest)):
            for folder in folders:
                scratch.delete(self.spark, f"{self.path}/{folder}")
            self._check(max(self.versions()), graph)
        return self.load(version)

    def _check(self, last: int, graph: Graph) -> None:
        if last != graph.version:
            raise StoreError(f"the graph at {self.path} went on to version {last} while this change was made from version {graph.version}")

    def expire(self, keep: int = 2) -> list[int]:
        """Delete the parts that only versions before the last ``keep`` read, and these versions; those of which a part went."""
        known = self.versions()
        of = lambda vs: {p.folder: p.version for v in vs for own in self._parts(self._manifest(v)).values() for p in own}
        used, old = of(known[-keep:]), of(known[:-keep])
        gone = {v for folder, v in old.items() if folder not in used and scratch.delete(self.spark, f"{self.path}/{folder}")}
        for v in known[:-keep]:
            scratch.delete(self.spark, self._named(v))
        return sorted(gone)
