r"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Sources, by code point with null last, weigh 1, 2, 3 and so on again; together they get as many words
as the corpus has. A target stops at ``EPOCHS`` times its source's words, and the excess is reshared
by weight until no target is above.

A document's words count whole: every document of a source is taken floor(target / words of the
source) times, and the rest of the budget goes to documents whose hash is below the source's
threshold. The threshold is found without a sort: words are summed by source and hash digit, the digit
that crosses the budget is the boundary, and only its documents are summed by their next digit, until
the boundary is a single hash, which is taken if that comes closer to the budget. A larger budget
takes a superset of what a smaller one takes.

Defined results: null and empty texts have size 0; a null source is a source of its own; rows equal in
doc_id and text share a hash and are taken together, as often as they stand there; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: A hash is 60 bits of MD5, read as DIGITS digits of DIGIT_BITS bits.
DIGIT_BITS, DIGITS = 12, 5


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with the size and the 60-bit hash of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text)))
    return docs.withColumns({"size": common.n_words(text), "hash": F.conv(F.substring(digest, 1, DIGIT_BITS * DIGITS // 4), 16, 10).cast("long")})


def weighted(sources: DataFrame) -> DataFrame:
    """``sources`` with its weight by rank. Ranks come from a range partitioning and one offset a partition."""
    parts = common.written(sources.repartitionByRange(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part")), "sources")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, parts.groupBy("part").count().collect())):  # a row for each partition at most
        offsets.append((part, before))
        before += n
    nth = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    offset = F.create_map(*(F.lit(x) for pair in offsets for x in pair)) if offsets else F.create_map(F.lit(0), F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(nth + offset[F.col("part")], F.lit(len(WEIGHTS))) + 1).cast("int"))
    return parts.select("source", "source_size", "part", weight.cast("long").alias("weight")).drop("part")


def targeted(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size, weight) with the target of each."""
    sources = common.written(sources, "weights")
    share, total = None, sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = F.lit(False) if share is None else F.lit(share) * F.col("weight") > EPOCHS * F.col("source_size")
        at = sources.agg(F.sum(F.when(over, EPOCHS * F.col("source_size"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        now = (total - (at.full or 0)) / at.open if at.open else 0.0
        if share is not None and now <= share:
            break
        share = now
    return sources.withColumn("target", F.least(F.lit(share) * F.col("weight"), EPOCHS * F.col("source_size").cast("double")))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source of ``budgets`` (source, budget in words): ``below``, the hash from which on nothing is taken.

    docs has source, size and hash. Each round sums the boundary's documents by their next digit.
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for k in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - k)
        # with round k, prefix holds the k leading digits of the boundary
        d, s = docs.alias("d"), state.alias("s")
        same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright("d.hash", shift + DIGIT_BITS) == F.col("s.prefix"))
        sums = d.join(s, same).groupBy(F.col("s.source").alias("source"), "left", "prefix", F.shiftright("d.hash", shift).alias("digit")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("digit"))
        sums = sums.withColumn("upto", upto)
        crossed = sums.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("digit", (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), "words")).alias("x"))
        state = common.written(crossed.select("source", F.col("x.left").alias("left"), F.col("x.digit").alias("prefix"), F.col("x.words").alias("words")), "boundary")
    nearer = F.col("left") * 2 >= F.col("words")
    # A source whose documents never cross its budget is taken whole.
    edge = state.select(F.col("source").alias("at"), (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("below"))
    out = budgets.join(edge, budgets.source.eqNullSafe(edge["at"]), "left")
    return out.select(budgets.source, F.coalesce("below", F.lit(1 << (DIGIT_BITS * DIGITS))).alias("below"))


def mix(sizes: DataFrame) -> DataFrame:
    """at (the source), source_size, target, whole and below of each source of ``sizes`` (source, size, hash).

    A document is taken ``whole`` times, and once more if its hash is less than ``below``.
    """
    sources = common.written(targeted(weighted(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole)
    budgets = sources.where("source_size > 0").select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    edges = thresholds(sizes, common.written(budgets, "budgets")).withColumnRenamed("source", "at")
    return common.written(sources.join(edges, F.col("source").eqNullSafe(F.col("at")), "left").drop("at", "weight").withColumnRenamed("source", "at"), "mix")


def taken(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (source, hash and others) with their source's columns and ``times``, how often the mix takes each."""
    times = F.least(F.col("whole") + F.when(F.col("hash") < F.coalesce("below", F.lit(0)), 1).otherwise(0), F.lit(EPOCHS).cast("long"))
    return rows.join(sources, F.col("source").eqNullSafe(F.col("at"))).withColumn("times", times)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    sizes = common.written(sized(docs).select("doc_id", "source", "size", "hash"), "sizes", docs.count())
    return taken(sizes, mix(sizes)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source
), r(n, share) AS (
  SELECT 0, (SELECT sum(source_size)::DOUBLE / sum(weight)::DOUBLE FROM s)
  UNION ALL
  SELECT n + 1, (SELECT ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) FILTER (r.share * weight > 3 * source_size), 0))::DOUBLE
    / (sum(weight) FILTER (NOT r.share * weight > 3 * source_size))::DOUBLE FROM s) FROM r WHERE n < 60
), t AS (
  SELECT source, source_size, least((SELECT max(share) FROM r) * weight, 3 * source_size::DOUBLE) AS target FROM s
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), e AS (
  SELECT source, min(h) AS edge, arg_min((budget - (upto - same)) * 2 >= same, h) AS nearer FROM c WHERE upto > budget GROUP BY source
)
SELECT c.doc_id, c.size, c.source_size, c.target, (c.size * (c.whole + CASE WHEN c.source_size > 0 AND (e.edge IS NULL OR h < e.edge OR h = e.edge AND nearer) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.source
"""
