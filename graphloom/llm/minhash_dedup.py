"""MinHash near-dedup with sequential Bayesian verification.

Documents are linked when the Jaccard similarity of their sets of word shingles reaches ``similar``.

1. Each document gives the number of its shingles, a 128-bit digest of the set and ``BANDS`` bands of
   eight one-byte minima (a band is a long). Documents with equal sets are one class, represented by
   its smallest doc_id; only representatives go on.
2. Representatives that share a band are candidates. In each bucket the smallest one is paired with
   the others; the pairs are verified and give first components.
3. Buckets that still hold several components are compared whole, in blocks of bounded size: pairs of
   different components, each in the first band that it shares, never a pair within a component.
4. Verification compares the signatures a batch at a time and drops a pair as soon as the posterior
   chance (uniform prior) that its similarity reaches the threshold is under ``MISS`` (at the last look
   ``LAST_MISS``). Survivors are verified exactly on their full sets of 64-bit shingle hashes.

A pair at the threshold shares no band with a chance of (1 - 0.8^8)^80 < 5e-7.

Defined results: words are lower-cased in A-Z only; a text of fewer words than a shingle is one
shingle; very long texts are hashed and sketched in stretches, and a task holds the text and its whole set of
shingles, eight bytes each;
null and empty texts have none, are linked with nothing and stay. Rows that share a doc_id
are one node for linking. A null doc_id is linked only to equal sets and never represents a class
that has a doc_id; where a class has none, component_id is null and its rows stay. Further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, winnow
from .components import components

SHINGLE, SIMILAR = 5, 80
BANDS, ROWS = 80, 8
#: Minima compared between two looks at the posterior; the chance of a miss at each look but the last, and at the last.
BATCH, MISS, LAST_MISS = 64, 1e-9, 1e-6
#: Members of a bucket that are compared with each other at once, and rows that go to a task together.
BLOCK, DEALT = 2048, 4096
#: Words of a text whose shingles are hashed at once.
STRETCH = 1 << 18
_SEED = 20240229


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    draw = lambda: rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
    return draw(), draw() | np.uint32(1)


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one document's hashed words."""
    return joined_set([words], shingle)


def joined_set(parts: Iterable[np.ndarray], shingle: int) -> np.ndarray:
    """``shingle_set`` of a document whose hashed words come in parts."""
    found: list[np.ndarray] = []
    held = np.zeros(0, np.uint64)
    for words in parts:
        for at in range(0, len(words), STRETCH):
            held = np.concatenate([held, words[at : at + STRETCH]])
            if len(held) >= shingle:
                found.append(np.unique(winnow.rolled(held, shingle) ^ np.uint64(shingle)))
                held = held[len(held) - shingle + 1 :]
    if not found:
        return winnow.rolled(held, len(held)) ^ np.uint64(len(held)) if len(held) else held
    if len(found) == 1:
        return found[0]
    out = np.concatenate(found)
    found.clear()
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-byte minima of non-empty sets, BANDS * ROWS columns."""
    flips, factors = _functions()
    if len(sets) == 1 and len(sets[0]) > STRETCH:
        parts = [sets[0][at : at + STRETCH] for at in range(0, len(sets[0]), STRETCH)]
        return _top(np.minimum.reduce([_minima([x], flips, factors) for x in parts]))
    return _top(_minima(sets, flips, factors))


def _minima(sets: list[np.ndarray], flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x = np.concatenate(sets).astype(np.uint32)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(flips)), np.uint32)
    for k, (flip, factor) in enumerate(zip(flips, factors)):
        out[:, k] = np.minimum.reduceat((x ^ flip) * factor, begin)
    return out


def _top(minima: np.ndarray) -> np.ndarray:
    """A byte of each."""
    return ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def least_matches(n: int, similar: int = SIMILAR, miss: float = MISS) -> int:
    """Fewest matches among n minima with which a pair may still be similar.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    t = similar / 100 + (1 - similar / 100) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log(1 - t))
        if tail >= miss:
            return m
    return n


def _steps(similar: int) -> list[tuple[int, int, int]]:
    n = BANDS * ROWS
    ends = range(BATCH, n + 1, BATCH)
    return [(end - BATCH, end, least_matches(end, similar, MISS if end < n else LAST_MISS)) for end in ends]


def _matching(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """Rows of the signatures a and b (a may be one row) that pass every look."""
    left, found = np.arange(len(b)), np.zeros(len(b), np.int64)
    for begin, end, least in steps:
        mine = a[left, begin:end] if len(a) == len(b) else a[:, begin:end]
        found = found + (mine == b[left, begin:end]).sum(axis=1)
        keep = found >= least
        left, found = left[keep], found[keep]
        if not len(left):
            break
    return left


def _bytes(column: pa.Array) -> np.ndarray:
    """Signatures of a column of bands, a row each."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, BANDS * ROWS)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple]:
    for batch in batches:
        for part in common.slices(batch, alone=common.SLICE_BYTES):
            texts = [b"" if x is None else x for x in part.column("text").cast(pa.binary()).to_pylist()]
            if len(texts) == 1:
                yield part, [joined_set((winnow.hashed(x.lower().split()) for x in common.pieces(texts.pop(), common.BLANK)), shingle)]
                continue
            split = [x.lower().split() for x in texts]
            ends = np.cumsum([len(x) for x in split])
            words = winnow.hashed([w for x in split for w in x])
            yield part, [shingle_set(words[e - len(x) : e], shingle) for x, e in zip(split, ends)]


def _class_of(sets: list[np.ndarray]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)]


def _sketch(shingle: int) -> Callable:
    def run(batches):
        for part, sets in _sets(batches, shingle):
            full = [i for i, x in enumerate(sets) if len(x)]
            bands = np.zeros((0, BANDS), np.int64) if not full else signatures([sets[i] for i in full]).view(np.int64)
            counts = np.zeros(len(sets) + 1, np.int32)
            counts[np.array(full, np.int64) + 1] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), *_class_of(sets), lists], ["doc_id", "n_shingles", "c1", "c2", "bands"])

    return run


def _full_sets(shingle: int) -> Callable:
    def run(batches):
        for part, sets in _sets(batches, shingle):
            begin = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_class_of(sets), pa.ListArray.from_arrays(pa.array(begin), pa.array(values))], ["node", "c1", "c2", "shingles"])

    return run


def _prune(similar: int) -> Callable:
    def run(batches):
        steps = _steps(similar)
        for batch in batches:
            if batch.num_rows:
                kept = _matching(_bytes(batch.column("sa")), _bytes(batch.column("sb")), steps)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept)) for c in ("a", "b")], ["a", "b"])

    return run


def _blocks(similar: int) -> Callable:
    """Pairs of different components in each block of a bucket that pass the sequential test."""

    def run(table: pa.Table) -> pa.Table:
        table, steps = table.sort_by([("pos", "ascending"), ("band", "ascending"), ("lo", "ascending"), ("hi", "ascending")]).combine_chunks(), _steps(similar)
        cols = {c: table.column(c).to_numpy() for c in ("pos", "band", "lo", "hi", "node", "root", "block", "n")}
        sig = _bytes(table.column("bands").combine_chunks())
        bands = sig.view(np.int64)
        new = np.zeros(len(sig), bool)
        new[0] = True
        for c in ("pos", "band", "lo", "hi"):
            new[1:] |= cols[c][1:] != cols[c][:-1]
        begins = np.flatnonzero(new)
        a, b = [], []
        for begin, end in zip(begins, [*begins[1:], len(sig)]):
            for i in range(begin, end - 1):
                r = slice(i + 1, end)
                ok = (cols["root"][r] != cols["root"][i]) & (100 * np.minimum(cols["n"][r], cols["n"][i]) >= similar * np.maximum(cols["n"][r], cols["n"][i]))
                if cols["lo"][i] != cols["hi"][i]:
                    ok &= cols["block"][r] != cols["block"][i]
                at = i + 1 + np.flatnonzero(ok)
                if len(at):
                    at = at[(bands[at] == bands[i]).argmax(axis=1) == cols["pos"][i]]
                    at = at[_matching(sig[i : i + 1], sig[at], steps)]
                    a.append(np.full(len(at), cols["node"][i]))
                    b.append(cols["node"][at])
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": join(a), "b": join(b)})

    return run


def minhash_dedup(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, a row for each document.

    docs needs doc_id and text; ``similar`` is a percentage.
    """
    texts, rows = docs.select("doc_id", "text"), docs.count()

    def written(df: DataFrame, name: str, upto: int | None = rows) -> DataFrame:
        return common.written(df, name, upto)

    sketches = written(texts.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>"), "sketches", None)  # costs much: small tasks are soon done again
    classes = written(sketches.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = written(
        sketches.where("n_shingles > 0").join(classes.where("node is not null").withColumnRenamed("node", "doc_id"), ["doc_id", "c1", "c2"]).withColumnRenamed("doc_id", "node").withColumnRenamed("n_shingles", "n"), "nodes"
    )

    banded = nodes.select("node", F.posexplode("bands").alias("pos", "band"))
    buckets = written(banded.groupBy("pos", "band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").drop("last"), "buckets")
    members = written(banded.join(common.small(buckets, buckets.count(), 24), ["pos", "band"]), "members")
    joined = members.select("node").distinct()
    joined = common.small(joined, joined.count(), 8)
    near = written(nodes.join(joined, "node", "left_semi"), "near")
    sets = texts.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(_full_sets(shingle), "node long, c1 long, c2 long, shingles array<long>")
    sets = written(sets.join(near.select("node", "c1", "c2"), ["node", "c1", "c2"], "left_semi").select("node", "shingles"), "sets")

    def side(table: DataFrame, key: str, *cols: str) -> DataFrame:
        return table.select(F.col("node").alias(key), *(F.col(c).alias(f"{c[0]}{key}") for c in cols))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * shared >= similar * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

    signed = near.select("node", "n", F.col("bands").alias("signature"))
    stars = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(side(signed, "a", "n", "signature"), "a").join(side(signed, "b", "n", "signature"), "b")
    stars = stars.where(100 * F.least("na", "nb") >= similar * F.greatest("na", "nb")).select("a", "b", "sa", "sb")
    links = written(verified(stars.mapInArrow(_prune(similar), "a long, b long")), "stars")

    rooted = members.join(components(links, rows), "node", "left").select("pos", "band", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("pos", "band").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed = mixed.select("pos", "band", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    open_ = rooted.join(mixed, ["pos", "band"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    open_ = written(open_.select("pos", "band", "node", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")), "open")
    groups = max(1, -(-open_.count() // DEALT))
    rest = (
        open_.join(near.select("node", "n", "bands"), "node")
        .groupBy(F.pmod(F.xxhash64("pos", "band", "lo", "hi"), F.lit(groups)).alias("g"))
        .applyInArrow(_blocks(similar), "a long, b long")
    )
    roots = components(links.union(verified(rest)), rows)

    classes = classes.join(roots, "node", "left").select("c1", "c2", F.coalesce("root", "node").alias("component"))
    empty = F.col("n_shingles") == 0
    out = sketches.drop("bands").join(classes, ["c1", "c2"], "left").withColumn("component_id", F.when(empty, F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(common.documents(spark, sf_dir), shingle=4)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b
), c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
