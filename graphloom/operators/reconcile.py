"""Upkeep of immutable tables: every change is a join that gives the next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ident import is_stale, staled


def carry_over(parsed: DataFrame, previous: DataFrame) -> DataFrame:
    """``parsed`` with the description of the previous version where uid and a non-empty diff_hash agree.

    Only empty descriptions are filled; stale ones are not carried.
    """
    old = previous.where((F.col("diff_hash") != "") & (F.col("description") != "") & ~is_stale(F.col("description")))
    old = old.groupBy("uid", "diff_hash").agg(F.min("description").alias("_old"))
    return parsed.join(old, ["uid", "diff_hash"], "left").withColumn("description", F.coalesce(F.nullif(F.col("description"), F.lit("")), "_old")).drop("_old").select(*parsed.columns)


def seed(parsed: DataFrame, lock: DataFrame) -> DataFrame:
    """Fill empty descriptions from a lockfile's entries (uid, diff_hash, description)."""
    return carry_over(parsed, lock)


def first_seen(parsed: DataFrame, stored: DataFrame, key: str = "id", date: str = "date_added") -> DataFrame:
    """``parsed`` with the earliest date that any version of a row had."""
    first = stored.groupBy(key).agg(F.min(date).alias("_first"))
    return parsed.join(first, key, "left").withColumn(date, F.least(date, "_first")).drop("_first").select(*parsed.columns)


def upsert(stored: DataFrame, parsed: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` with the rows of ``parsed`` in place of those with the same key; date_added stays the first one seen."""
    first = stored.groupBy(key).agg(F.min("date_added").alias("_first"))
    fresh = parsed.join(first, key, "left").withColumn("date_added", F.coalesce("_first", "date_added")).drop("_first")
    return stored.join(parsed.select(key), key, "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def replace_outbound(stored: DataFrame, parsed_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with those from the parsed nodes (id) replaced."""
    return stored.join(parsed_ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(*stored.columns).unionByName(edges.select(*stored.columns)).distinct()


def replace_vectors(stored: DataFrame, fresh: DataFrame, full: bool) -> DataFrame:
    """All vectors replaced after a full parse that gave any, else by id."""
    if full and not fresh.isEmpty():
        return fresh
    return stored.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def prune(stored: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows that the new version no longer has: the ids to delete."""
    return stored.join(kept.select(key), key, "left_anti")


def cascade_delete(deleted: DataFrame, structs: DataFrame, edges: DataFrame, vectors: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the nodes ``deleted`` (id), their edges at either end, vectors and notes."""
    gone = deleted.select("id").distinct()
    at = lambda df, column: df.join(gone.withColumnRenamed("id", column), column, "left_anti").select(*df.columns)
    return at(structs, "id"), at(at(edges, "source_id"), "target_id"), at(vectors, "id"), at(notes, "struct_id")


def mark_stale(structs: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """``structs`` with the descriptions of the changed ones marked, until they are described anew."""
    rows = structs.join(changed.select(key).distinct().withColumn("_changed", F.lit(True)), key, "left")
    marked = F.when(F.col("_changed") & ~is_stale(F.col("description")), staled(F.col("description"))).otherwise(F.col("description"))
    return rows.withColumn("description", marked).select(*structs.columns)


def parsed_wins(parsed: DataFrame, stored: DataFrame, key: str = "uid") -> DataFrame:
    """Both versions merged: a parsed row stands for the stored one of the same key."""
    return parsed.unionByName(stored.join(parsed.select(key), key, "left_anti").select(*parsed.columns))


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key: what supersedes all earlier ones."""
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(key, "x.*")
