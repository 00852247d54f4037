"""Source trees: files by their paths, directories from these.

Spark's own file readers pass over files of no bytes and over names that begin with an underscore, both of
which source trees hold (``__init__.py``). So paths are listed on the driver, as Spark's readers do, and
chunks of them are opened in tasks, through Arrow's file systems (local, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ident
from graphloom.sources import ignore

#: Language of each extension (fixed values).
LANGUAGES = {"py": "python", "java": "java", "html": "html", "htm": "html"}


#: Bytes of files that are handed over together, and that one task opens, about.
BATCH_BYTES, TASK_BYTES = 16 << 20, 64 << 20


def store_of(root: str) -> tuple[stores.FileSystem, str]:
    """The file system of a tree and where the tree lies in it."""
    if root.startswith("file:") or "://" not in root:
        return stores.LocalFileSystem(), f"/{root.removeprefix('file:').strip('/')}" if root.startswith(("file:", "/")) else root.rstrip("/")
    store, base = stores.FileSystem.from_uri(root)
    return store, base.rstrip("/")


def listed(root: str) -> list[tuple[str, int, int]]:
    """(path below ``root``, bytes, time of change in nanoseconds) of every file in a known language."""
    store, base = store_of(root)
    found = store.get_file_info(stores.FileSelector(base, recursive=True, allow_not_found=True))
    return [(f.path[len(base) + 1 :], f.size, f.mtime_ns or 0) for f in found if f.type == stores.FileType.File and f.extension.lower() in LANGUAGES]


def scan(spark: SparkSession, root: str, rules: list[str] | None = None, language: str = "auto") -> DataFrame:
    """(path, content, lang) of every file below ``root`` in a language of the project that is not ignored.

    Paths are relative to ``root``. Without ``rules`` the languages' defaults hold. Ignored files are not opened.
    """
    files = listed(root)
    paths = spark.createDataFrame([(p,) for p, _, _ in files], "path string")
    tasks = max(spark.sparkContext.defaultParallelism, sum(n for _, n, _ in files) // TASK_BYTES)
    return _read(root, paths, max(1, min(tasks, len(files))), rules, language)


def read(root: str, paths: DataFrame, rules: list[str] | None = None, language: str = "auto") -> DataFrame:
    """As ``scan``, of the files ``paths`` (path, relative to ``root``) only: no other file is listed or opened. Those that are gone are left out."""
    return _read(root, paths.select("path").distinct(), paths.sparkSession.sparkContext.defaultParallelism, rules, language)


def _read(root: str, paths: DataFrame, tasks: int, rules: list[str] | None, language: str) -> DataFrame:
    """Files of different ``paths``, opened in so many tasks (a number that Spark does not merge, as the paths alone are small)."""
    if rules is None:
        rules = [r for lang, rs in ignore.DEFAULTS.items() if language in ("auto", lang) for r in rs]
    lang = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[F.lower(F.substring_index("path", ".", -1))]
    wanted = paths.select("path", lang.alias("lang")).where(F.col("lang").isNotNull() if language == "auto" else F.col("lang") == language)
    wanted = wanted.where(~ignore.is_ignored(F.col("path"), F.lit(False), rules)).repartition(tasks)
    return wanted.mapInArrow(_opened(root), "path string, content binary, lang string")


def _opened(root: str) -> Callable:
    def run(batches):
        store, base = store_of(root)
        for batch in batches:
            names, langs = batch.column("path").to_pylist(), batch.column("lang").to_pylist()
            rows, size = [], 0
            for info, name, lang in zip(store.get_file_info([f"{base}/{x}" for x in names]), names, langs):
                if info.type != stores.FileType.File:
                    continue
                try:
                    with store.open_input_stream(info.path) as file:
                        rows.append((name, file.read(), lang))
                except FileNotFoundError:  # deleted meanwhile
                    continue
                size += len(rows[-1][1])
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple[str, bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.string()))], ["path", "content", "lang"])


def directories(paths: DataFrame) -> DataFrame:
    """(uid, name, type, path, parent_uid, id) of the directories above the files ``paths`` (path), the root included."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    rows = paths.select(F.explode(above).alias("uid")).distinct()
    parent = F.when(F.col("uid") != ".", ident.parent_path(F.col("uid")))
    kind = F.lit("directory")
    return rows.select("uid", F.substring_index("uid", "/", -1).alias("name"), kind.alias("type"), F.col("uid").alias("path"), parent.alias("parent_uid"), ident.node_id(kind, F.col("uid")).alias("id"))
