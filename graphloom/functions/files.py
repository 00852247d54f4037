"""Small files on any store that Spark reads, through Hadoop's file systems on the driver."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no such folder."""
    fs, at = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole unless there is one of that name, as one step that a single writer wins; whether it did.

    The text goes to a file of another name first. On the local file system a hard link gives it its name,
    elsewhere a rename that does not overwrite; both fail where the name is taken.
    """
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return True
        jvm = spark._jvm
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, at, none)
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)
