"""The corpus pipeline: language ID, line dedup, near dedup, mixing, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all that its predecessor kept. All but
the last return the columns of ``documents``; ``run`` writes each result as Parquet in the shared
folder and reads it for the next stage.

A lost executor costs the tasks of one stage at most: every stage begins from a written table.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, language_id, line_dedup, minhash_dedup, mixing, packing


def _files(docs: DataFrame, out: DataFrame) -> DataFrame:
    """What a stage makes of ``docs``, in files neither small nor many."""
    return common.in_files(out, docs.count())


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in no language: without a letter, or coded no shorter than by a uniform guess."""
    rest = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`").alias(n) for c, n in rest.items())).alias("rest"))
    rows = language_id.identify(rows, language_id.learned(docs))
    rows = rows.where((F.col("lang_pred") != "und") & (F.col("bits") < log2(language_id.SYMBOLS)))
    return _files(docs, rows).select(*("text" if c == "text" else F.col(f"rest.{rest[c]}").alias(c) for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of three lines or more; n_chars follows the text. Documents that lose all their words go.

    Shorter repeats stay here: near copies share single lines, and without these the next stage could
    not tell them for what they are.
    """
    rest = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(n) for c, n in rest.items())).alias("rest"))
    out = line_dedup.line_dedup(rows, gram=2, window=2, long_words=None)
    out = _files(docs, out.where((F.col("n_removed") == 0) | F.col("text").rlike(common.WORD)))
    by = {c: F.col(f"rest.{n}") for c, n in rest.items()} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    by |= {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*(by[c].alias(c) for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (five words, similarity 0.8): the one with the smallest doc_id, null last.

    Every row is judged under an id of its own, so rows that share a doc_id or have none are judged too.
    """
    rest, n = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}, docs.count()
    rows = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.struct(*(F.col(f"`{c}`").alias(k) for c, k in rest.items())).alias("rest"))
    rows = common.written(rows, "rows", n)  # read again and again, with the same ids
    ids = rows.select("doc_id", F.col(f"rest.{rest['doc_id']}").alias("id"))
    judged = minhash_dedup.minhash_dedup(rows).select("doc_id", "component_id").join(ids, "doc_id")
    first = judged.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("first"))
    out = common.in_files(rows.join(first.select("first.doc_id"), "doc_id", "left_semi"), n)
    return out.select(*("text" if c == "text" else F.col(f"rest.{rest[c]}").alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks; a document taken twice stands twice, one not taken goes."""
    rows = mixing.sized(docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"), "doc_id", "text", "source")).drop("text")
    sizes = common.written(rows.select("doc_id", "source", "size", "hash"), "sizes", docs.count())
    out = mixing.taken(rows, mixing.mix(sizes)).where("times > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return _files(docs, out).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return _files(docs, packing.pack(docs))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: PPM and the tokenizer cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name, docs.count())
    return STAGES[-1][1](spark, docs, sf_dir)
