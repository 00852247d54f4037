"""Exact nearest neighbours with cells that need not be looked at.

Rows are dealt out to the nearest of a few centers, which are rows themselves; a cell's radius is the
distance of its farthest row. A first search in the cells around a query gives an upper bound of its k-th
distance. By the triangle inequality only cells whose center is at most bound + radius away can hold nearer rows,
and of these only rows whose own distance from the center differs from the query's by the bound at most.
Clustered vectors leave a small part of all pairs; without clusters all cells are searched, still exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scratch import written
from graphloom.operators.search import ROWS

#: Centers at most; their vectors are collected and broadcast.
CENTERS = 1024
#: What rounding can add to a distance, as a share of it.
SLACK = 1e-9


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _away(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of all vectors to all centers."""
    return np.stack([np.sqrt(((vectors - c) ** 2).sum(axis=1)) for c in centers], axis=1)


def _dealt(held) -> Callable:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                away = _away(_matrix(batch.column("vector"), batch.num_rows), held.value)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], ["id", "vector", "cell", "away"])

    return run


def _asked(held, k: int, first: bool) -> Callable:
    """Queries with each cell to look at: the nearest ones that hold k other rows, or the others that the bound leaves."""

    def run(batches):
        centers, sizes, radii = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _away(_matrix(batch.column("vector"), batch.num_rows), centers)
            order = away.argsort(axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            near = np.zeros(away.shape, bool)
            np.put_along_axis(near, order, before < k + 1, axis=1)
            bound = np.full(batch.num_rows, np.inf) if first else batch.column("bound").fill_null(np.inf).to_numpy(zero_copy_only=False)
            wanted = (near if first else ~near & (away <= (bound[:, None] + radii) * (1 + SLACK))) & (sizes > 0)
            q, c = np.nonzero(wanted)
            own = [batch.column("id").take(pa.array(q)), batch.column("vector").take(pa.array(q)), pa.array(c.astype(np.int32)), pa.array(away[q, c]), pa.array(bound[q])]
            yield pa.RecordBatch.from_arrays(own, ["id", "vector", "cell", "away", "bound"])

    return run


def _compared(k: int, pairs: Accumulator) -> Callable:
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out, seen = [], 0
        if queries.num_rows and rows.num_rows:
            away = rows.column("away").to_numpy()
            order = np.argsort(away, kind="stable")
            away, ids = away[order], rows.column("id").to_numpy()[order]
            values = _matrix(rows.column("vector").combine_chunks(), rows.num_rows)[order]
            vectors = _matrix(queries.column("vector").combine_chunks(), queries.num_rows)
            for q, vector, at, bound in zip(queries.column("id").to_numpy(), vectors, queries.column("away").to_numpy(), queries.column("bound").to_numpy()):
                reach = bound + SLACK * (bound + at) if np.isfinite(bound) else np.inf
                lo, hi = np.searchsorted(away, at - reach, "left"), np.searchsorted(away, at + reach, "right")
                distance = np.sqrt(((vector - values[lo:hi]) ** 2).sum(axis=1))
                best = np.lexsort((ids[lo:hi], distance))[: k + 1]
                out.append((np.full(len(best), q), ids[lo:hi][best], distance[best]))
                seen += hi - lo
        pairs.add(int(seen))
        columns = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "distance"), columns)))

    return run


def _best(near: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return near.where("query_id <> id").withColumn("nth", nth).where(F.col("nth") <= k)


def knn_pruned(queries: DataFrame, vectors_: DataFrame, k: int = 5, centers: int | None = None) -> tuple[DataFrame, float]:
    """(query_id, id, distance, nth) as ``search.knn_join`` gives, and the share of all pairs that were compared.

    Both sides have id and vector, of one length and without nulls; ids are those of the queries themselves where
    these stand among the rows. A cell with many rows is dealt out to blocks of ``ROWS``, equal rows too.
    """
    spark, m = queries.sparkSession, vectors_.count()
    centers = centers or min(CENTERS, max(1, math.isqrt(m)))
    picked = np.array([r.vector for r in vectors_.orderBy(F.xxhash64("id"), "id").limit(centers).select("vector").collect()], np.float64)
    if not len(picked):
        return queries.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("distance"), F.lit(0).alias("nth")).limit(0), 0.0
    schema = f"id {vectors_.schema['id'].dataType.simpleString()}, vector {vectors_.schema['vector'].dataType.simpleString()}, cell int, away double"
    rows = written(vectors_.select("id", "vector").mapInArrow(_dealt(spark.sparkContext.broadcast(picked)), schema), "cells")
    sizes, radii = np.zeros(len(picked), np.int64), np.zeros(len(picked))
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():  # a row a center
        sizes[r.cell], radii[r.cell] = r.n, r.radius
    blocks = -(-sizes // ROWS)
    held, of_cell, pairs = spark.sparkContext.broadcast((picked, sizes, radii)), F.array(*(F.lit(int(x)) for x in blocks)), spark.sparkContext.accumulator(0)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.get(of_cell, F.col("cell"))).cast("int"))

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        cells = asked.mapInArrow(_asked(held, k, first), f"{schema}, bound double")
        cells = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(of_cell, F.col("cell")) - 1)))
        met = cells.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block"))
        return written(met.applyInArrow(_compared(k, pairs), "query_id long, id long, distance double"), "near")

    near = searched(queries.select("id", "vector"), True)
    bound = _best(near, k).groupBy(F.col("query_id").alias("id")).agg(F.max(F.when(F.col("nth") == k, F.col("distance"))).alias("bound"))
    more = searched(queries.select("id", "vector").join(bound, "id", "left"), False)
    n = queries.count()
    return _best(near.unionByName(more).distinct(), k), pairs.value / max(1, n * m)
