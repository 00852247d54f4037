"""The lockfile: descriptions and notes that a project keeps under version control, as one JSON file."""

from __future__ import annotations

import filecmp
import json
from collections.abc import Iterable
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ident import is_stale

VERSION = 1
_ENTRY = "struct<diff_hash:string,description:string,vector:array<double>>"
_NOTE = "struct<content:string,author:string,date_added:string,date_last_updated:string>"
SCHEMA = f"lock_version int, format_version int, entries map<string,{_ENTRY}>, notes map<string,array<{_NOTE}>>"


def read(spark: SparkSession, path: str, format_version: int) -> DataFrame | None:
    """The lockfile as one row, or None if it is missing, corrupt or of another format."""
    try:
        df = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
        row = df.select("lock_version", "format_version").first()
    except Exception as e:  # missing and malformed files raise from Spark in several classes
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "MALFORMED", "FAILED_READ_FILE")):
            return None
        raise
    return df if row and row.lock_version == VERSION and row.format_version == format_version else None


def entries(lock: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(uid, diff_hash, description)."""
    if lock is None:
        return spark.createDataFrame([], "uid string, diff_hash string, description string")
    return lock.select(F.explode("entries").alias("uid", "e")).select("uid", "e.diff_hash", "e.description")


def notes(lock: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(uid, content, author, date_added, date_last_updated)."""
    if lock is None:
        return spark.createDataFrame([], "uid string, content string, author string, date_added string, date_last_updated string")
    return lock.select(F.explode("notes").alias("uid", "ns")).select("uid", F.inline("ns"))


def exported(structs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(uid, entry) of the described nodes that are not stale; with ``vectors`` (id, vector) these too."""
    rows = structs.where((F.col("description") != "") & ~is_stale(F.col("description")))
    fields = [F.col("diff_hash"), F.col("description")]
    if vectors is not None:
        rows = rows.join(vectors.select("id", "vector"), "id", "left")
        fields.append(F.col("vector"))
    return rows.select("uid", F.to_json(F.struct(*fields)).alias("entry"))


def _section(out: TextIO, name: str, rows: Iterable[tuple[str, str]]) -> None:
    """A JSON object with a member a line, from keys and JSON texts."""
    out.write(f'  "{name}": {{')
    last = ""
    for key, value in rows:
        out.write(f"{last}\n    {json.dumps(key, ensure_ascii=False)}: {json.dumps(json.loads(value), sort_keys=True, ensure_ascii=False)}")
        last = ","
    out.write("\n  }" if last else "}")


def write(path: Path, entries_: DataFrame, notes_: DataFrame, format_version: int) -> bool:
    """Write the file, a member a line in order of uid; False if that changes nothing.

    Rows come sorted from Spark, a partition at a time, into a file beside the old one, which then takes
    its place at once: a write that fails leaves the old file.
    """
    part = path.with_name(f"{path.name}.part")
    rows = entries_.select("uid", "entry"), notes_.select("uid", F.to_json("notes").alias("notes"))
    with part.open("w", encoding="utf-8") as out:
        out.write("{\n")
        _section(out, "entries", rows[0].orderBy("uid").toLocalIterator())
        out.write(f',\n  "format_version": {format_version},\n  "lock_version": {VERSION},\n')
        _section(out, "notes", rows[1].orderBy("uid").toLocalIterator())
        out.write("\n}\n")
    changed = not path.exists() or not filecmp.cmp(path, part, shallow=False)
    if changed:
        part.replace(path)
    else:
        part.unlink()
    return changed
