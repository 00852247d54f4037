"""Notes on nodes: a capped log for each node, with merges where the last writer wins.

Columns: note_id, struct_id, content, author, date_added, date_last_updated (ISO strings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scratch import written
from graphloom.operators.graph import ring

CAP = 10


def numbered(rows: DataFrame, high_water: int) -> DataFrame:
    """New notes (struct_id, date_added and others) with ids that were never used: all above ``high_water``.

    Rows are dealt out in ranges and counted by partition, so ids follow date_added and no task sees
    all rows; the driver gets one count a partition.
    """
    order = ["date_added", "struct_id", "content"]
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "notes")
    before, offsets = high_water, []
    for part, n in sorted(map(tuple, parts.groupBy("_part").count().collect())):
        offsets.append((part, before))
        before += n
    if not offsets:
        return rows.withColumn("note_id", F.lit(None).cast("long"))
    offset = F.create_map(*(F.lit(x) for pair in offsets for x in pair))[F.col("_part")]
    nth = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("note_id", (offset + nth).cast("long")).drop("_part")


def add(notes: DataFrame, new: DataFrame, cap: int = CAP) -> DataFrame:
    """Notes with new ones; each node keeps its last ``cap``."""
    return ring(notes.unionByName(new), "struct_id", "note_id", cap)


def edit(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Notes with content, author and date_last_updated of ``edits`` (by note_id); date_added never changes."""
    new = edits.select("note_id", *(F.col(c).alias(f"_{c}") for c in ("content", "author", "date_last_updated")))
    out = notes.join(new, "note_id", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("content", "author", "date_last_updated")}).select(*notes.columns)


def remove(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return notes.join(ids.select("note_id"), "note_id", "left_anti").select(*notes.columns)


def replace_all(notes: DataFrame, struct_id: str, new: DataFrame) -> DataFrame:
    return notes.where(F.col("struct_id") != struct_id).unionByName(new.select(*notes.columns))


def export(notes: DataFrame, structs: DataFrame) -> DataFrame:
    """(uid, notes): each node's notes in order of id, without ids; notes without a node are left out."""
    fields = ("content", "author", "date_added", "date_last_updated")
    named = notes.join(structs.select(F.col("id").alias("struct_id"), "uid"), "struct_id")
    return named.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("note_id", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("notes"))


def merge(local: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("struct_id", "author", "date_added"), updated: str = "date_last_updated") -> DataFrame:
    """Last writer wins by key: unknown notes come in, later incoming ones replace, equal or earlier ones do not.

    Both sides go through one aggregate on the key; ``local`` wins ties.
    """
    both = local.withColumn("_rank", F.lit(1)).unionByName(incoming.withColumn("_rank", F.lit(0)))
    rest = [c for c in local.columns if c not in keys and c != updated]
    return both.groupBy(*keys).agg(F.max(F.struct(updated, "_rank", *rest)).alias("x")).select(*keys, "x.*").drop("_rank").select(*local.columns)
