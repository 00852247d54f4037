"""What the operators share: document keys, intermediate tables, word counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scratch import scratch_path

#: White space that separates words, and a word, in the regular expressions of Spark.
SPACE = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"
#: One of them, in the bytes of a text.
BLANK = re.compile(rb"[\x20\x09-\x0D]")

#: Sides of joins up to this many bytes are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20

LAST = (1 << 63) - 1

#: Bytes of text that are handled at once in a task.
SLICE_BYTES = 2 << 20
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
FILE_ROWS = 50_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_files(df: DataFrame, rows: int = 0) -> DataFrame:
    """``df`` of about ``rows`` rows in as many partitions as there are cores, or one for ``FILE_ROWS`` rows if
    these are more. No shuffle: neighbouring partitions become one task, so a table has no small files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_ROWS`` rows at most while a table is being written; the session's own setting stands afterwards."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str, rows: int | None = 0) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later plans start from the table.

    ``rows`` is how many rows to expect at most, for tables that grow with the input; None leaves the
    partitions as they are, for tables that cost much to make.
    """
    path = scratch_path(df.sparkSession, name)
    with _small_batches(df.sparkSession):
        (df if rows is None else in_files(df, rows)).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str = "text", alone: int | None = None) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of ``batch`` with about ``SLICE_BYTES`` of text together; a text of more than ``alone`` bytes is a slice of its own.

    Spark hands over at most about 64 MB at once (or one row, if that is longer), and what is made of a
    text takes several times its size.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    if alone is not None:
        long = np.flatnonzero(sizes > alone)
        cuts = np.unique(np.r_[cuts, long[long > 0], long[long < batch.num_rows - 1] + 1])
    cuts = [0, *cuts, batch.num_rows]
    for at, end in zip(cuts, cuts[1:]):
        yield batch.slice(at, end - at)
    pa.default_memory_pool().release_unused()


def pieces(text: bytes, separator: re.Pattern, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``text`` in pieces of ``size`` bytes and what is left up to the next separator; the separators between pieces belong to none."""
    at = 0
    while len(text) - at > size and (cut := separator.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``BROADCAST_BYTES``, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def keyed(docs: DataFrame, *cols: str) -> DataFrame:
    """doc_id, whole text (null: empty) and ``cols`` with the row key (_k, _t).

    _k is doc_id, or the largest long for null; _t is a hash of the text, so that rows that share a
    doc_id keep apart. Rows equal in doc_id and text share a key and get the same result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("_k"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long")).alias("_t"),
        "doc_id",
        text.alias("text"),
        *cols,
    )


def n_words(text: str | Column) -> Column:
    """Number of words of a text; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
