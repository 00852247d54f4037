"""A stream merged into a table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.scratch import is_folder, scratch_path
from graphloom.operators.reconcile import latest


def upserted(spark: SparkSession, path: str, key: str, order: list[str], rest: list[str], files: int = 1, base: str | None = None) -> DataFrame:
    """The latest row of each key of a Parquet table read as a stream, ``files`` files a batch.

    Each batch is reduced to its latest rows before it meets the table, so the merge costs a row a key.
    ``base`` holds the versions and the checkpoint: a call with the folder of an earlier one goes on
    where that stopped, and a batch that is applied again after a failure writes its version again.
    """
    columns = [key, *order, *rest]
    schema = spark.read.parquet(path).select(*columns).schema
    base = base or scratch_path(spark, "upsert")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    folder, name = path.rstrip("/").rsplit("/", 1)
    # a stream reads folders: a table of one file is that file of its folder
    stream = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    stream = stream.select(*columns)

    def merge(batch: DataFrame, number: int) -> None:
        table = latest(batch, key, *order)
        if number:
            before = spark.read.schema(table.schema).parquet(f"{base}/version={number - 1}")
            table = latest(before.unionByName(table), key, *order)
        table.write.mode("overwrite").parquet(f"{base}/version={number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/checkpoint/commits")
    store = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in store.listStatus(commits) if f.getPath().getName().isdigit()] if store.exists(commits) else []
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{base}/version={max(done)}").select(*columns)
