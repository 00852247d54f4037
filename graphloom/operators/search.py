"""Exact nearest neighbours and centroids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import vectors
from graphloom.operators.graph import ancestors

#: Queries and rows of one tile at most, and values of one block of differences in a task.
QUERIES, ROWS, CELLS = 4096, 16384, 4 << 20


def of_kind(rows: DataFrame, kind: str, column: str = "type") -> DataFrame:
    """Rows whose kind holds a word, in either case."""
    return rows.where(F.contains(F.lower(column), F.lit(kind.lower())))


def nearest(vectors_: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The ``k`` rows (id, vector) nearest to one vector, with their distance: filter first, then this."""
    distance = vectors.l2_distance(F.col("vector"), F.array(*(F.lit(float(x)) for x in query)))
    return vectors_.withColumn("distance", distance).orderBy("distance", "id").limit(k)


def _values(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """ids, and vectors as one matrix."""
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return table.column("id").to_numpy(), flat.reshape(table.num_rows, -1)


def _tile(k: int) -> Callable:
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            (ids, matrix), (names, values) = _values(queries), _values(rows)
            step = max(1, CELLS // values.size)
            for at in range(0, len(ids), step):
                distance = np.sqrt(((matrix[at : at + step, None, :] - values[None, :, :]) ** 2).sum(axis=2))
                order = np.lexsort((np.broadcast_to(names, distance.shape), distance), axis=1)[:, :k]
                out.append((np.repeat(ids[at : at + step], order.shape[1]), names[order].ravel(), np.take_along_axis(distance, order, axis=1).ravel()))
        columns = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "distance"), columns)))

    return run


def knn_join(queries: DataFrame, vectors_: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, distance, nth): the ``k`` nearest rows of ``vectors_`` to each of ``queries``, itself apart.

    Both have id and vector, of one length and without nulls. Queries and rows are dealt out to tiles, each
    a block of queries against a block of rows, so every pair meets once, in one plan and without the
    driver. A tile passes on k + 1 rows a query; blocks are as large as memory allows, since every row
    travels once for each block of queries.
    """
    spread = queries.sparkSession.sparkContext.defaultParallelism
    n, m = queries.count(), vectors_.count()
    across = max(1, -(-n // QUERIES))
    down = max(-(-m // ROWS), min(m, -(-spread // across)), 1)
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select("id", "vector", own(across).alias("q")).withColumn("r", every(down))
    right = vectors_.select("id", "vector", own(down).alias("r")).withColumn("q", every(across))
    near = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(_tile(k + 1), "query_id long, id long, distance double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return near.where("query_id <> id").withColumn("nth", nth).where(F.col("nth") <= k)


def _scaled(mean: Column) -> Column:
    """A vector (array) over its length, unless that is 1e-9 or less, as rows i, value."""
    return F.posexplode(vectors.normalised(mean)).alias("i", "value")


def mean_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, i, value): the mean vector of each key by place, scaled to length 1 unless it is shorter than 1e-9.

    Vectors are added up whole, on the map side first, so what travels is a vector for each key and task.
    """
    means = rows.groupBy(key).agg(Summarizer.mean(array_to_vector("vector")).alias("mean"))
    return means.select(key, _scaled(vector_to_array("mean")))


def subtree_centroids(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(id, i, value): for each node the mean of all leaf vectors below it; nodes without any are left out.

    leaves has id (a node's) and vector. Sums by leaf node come before the tree, so a leaf's rows are
    counted once however deep it lies.
    """
    sums = leaves.groupBy("id").agg(Summarizer.sum(array_to_vector("vector")).alias("s"), F.count("*").alias("n"))
    means = sums.join(ancestors(nodes).select("id", "ancestor_id"), "id").groupBy("ancestor_id").agg(Summarizer.sum(F.col("s")).alias("s"), F.sum("n").alias("n"))
    mean = F.transform(vector_to_array("s"), lambda x: x / F.col("n"))
    return means.select(F.col("ancestor_id").alias("id"), mean.alias("mean")).select("id", _scaled(F.col("mean")))
