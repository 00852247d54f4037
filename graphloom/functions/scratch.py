"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder that stands in on a local master, and the tables of this application.
_own: list[str] = []
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; without that setting in a folder of this machine, for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="graphloom-"))
        base = f"file://{_own[0]}"
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans start from the table."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder on any store that Spark reads; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def listed(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Bytes and time of change (milliseconds) of each file of a folder on any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [(f.getLen(), f.getModificationTime()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def discard(table: DataFrame) -> None:
    """Delete a written table that no plan will read again; other tables are left alone."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        for path in [p for p in _made if folder.endswith(p.rsplit("/", 1)[-1])]:
            delete(table.sparkSession, path)
            _made.remove(path)


def clear(spark: SparkSession) -> int:
    """Delete all tables that this application has made, once its results are written elsewhere; how many there were."""
    for path in _made:
        delete(spark, path)
    n = len(_made)
    _made.clear()
    return n
