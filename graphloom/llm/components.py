"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scratch import discard

from .common import written


def components(links: DataFrame, rows: int = 0) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that it reaches, itself included.

    Each round is two aggregates and two joins over the links that are left; their number never
    grows (``rows``: about how many there are at most), and a component of n nodes needs about log n rounds. Every round is a written table.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links", rows)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(least.withColumnRenamed("m", "v").union(rest).distinct(), "links", rows)
        discard(before)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == seen or not now.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
