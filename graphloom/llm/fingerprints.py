r"""Document fingerprints by randomised edit embedding.

A text is walked character by character along an endless row of steps. At step j a character c is
read again or left behind by a random bit r(j, c), shared by all texts (c in ``CLASSES`` classes, j
modulo ``PERIOD``), so a character takes two steps on average and two texts that differ by an edit
fall back into step soon after it: edit distance becomes Hamming distance along the steps.

The fingerprint samples the walk: in each of the ranges of 16, 32, 64, ... steps, ``SAMPLES`` fixed
steps give four bits each, hashed from the character there and the two before it. It is written as the
number of sampled steps and a hexadecimal digit for each. A range's samples stand for its length, so
likeness - the weighted share of equal samples over the longer walk, less what chance gives - follows
the Hamming distance of the whole embeddings. Every character of a text takes part.

Banding: ``BAND`` consecutive sampled digits of a range are a band; two texts that share one of the
bands of their last ranges are candidates, verified by likeness. ``near_pairs`` does so for a table: the
members of a bucket with its smallest, then, in blocks of bounded size, those that are still in different
components. ``near_groups`` gives every document its class of equal fingerprints and its component.

Defined results: null texts are empty; the fingerprint of an empty text is ``0:`` and like only itself;
very long texts are walked whole in stretches, and a task holds the text, its neighbour and two bytes for each character of
both and of the edited one; documents stand in ascending order of doc_id, equal ones by text; those without one follow in order of a
hash of their text, and the first of all follows the last; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

CLASSES, PERIOD, SAMPLES, RANGES = 64, 1024, 32, 40
BAND, LAST_RANGES = 4, 3
#: Members of a bucket that are compared with each other at once.
BLOCK = 512
#: Characters that are walked at once.
STRETCH = 1 << 16
_SEED, _CHANCE = 20240307, 1 / 16


@lru_cache(maxsize=1)
def _walkers() -> list[list[int]]:
    """For each class and step, the step after the one at which the character is left."""
    bits = np.random.default_rng(_SEED).integers(0, 2, (CLASSES, PERIOD))
    bits[:, 0] = 1
    steps = list(range(PERIOD))
    rows = []
    for row in bits:
        after, at = [0] * PERIOD, 1
        for j in range(PERIOD - 1, -1, -1):
            if row[j]:
                at = (j + 1) % PERIOD
            after[j] = steps[at]
        rows.append(after)
    return rows


@lru_cache(maxsize=1)
def _sampled() -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps, ascending, and the weight of each."""
    rng = np.random.default_rng(_SEED + 1)
    steps, weights, at = [], [], 0
    for k in range(RANGES):
        width = 16 << k
        steps.append(np.sort(at + rng.integers(0, width, SAMPLES)))
        weights.append(np.full(SAMPLES, width / SAMPLES))
        at += width
    return np.concatenate(steps), np.concatenate(weights)


class Walk:
    """The walk over one text, in stretches of characters; ``then`` continues from any character of it with other text.

    Of each character the number of its steps is kept, in two bytes, and where each stretch ends.
    """

    def __init__(self, text: str, before: Walk | None = None, keep: int = 0):
        self.text = before.text[:keep] + text if before else text
        self.gaps = np.empty(len(self.text), np.uint16)
        self.gaps[:keep] = before.gaps[:keep] if before else 0
        j = (before.end(keep) if before else 0) % PERIOD
        for at in range(0, len(text), STRETCH):
            points = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le"), np.uint32)
            classes = ((points * np.uint32(0x9E3779B1)) >> np.uint32(20)) & np.uint32(CLASSES - 1)
            steps = np.empty(len(points) + 1, np.int16)
            steps[0] = j
            rows, out = _walkers(), []
            add = out.append
            for c in classes.astype(np.uint8).tobytes():
                j = rows[c][j]
                add(j)
            steps[1:] = out
            gap = np.diff(steps) % PERIOD
            gap[gap == 0] = PERIOD
            self.gaps[keep + at : keep + at + len(gap)] = gap
        self.stretches = np.cumsum([self.gaps[at : at + STRETCH].sum(dtype=np.int64) for at in range(0, len(self.gaps), STRETCH)], dtype=np.int64)
        self._digits: np.ndarray | None = None

    def end(self, n: int) -> int:
        """The step after the first ``n`` characters."""
        k = n // STRETCH
        return int(self.stretches[k - 1] if k else 0) + int(self.gaps[k * STRETCH : n].sum(dtype=np.int64))

    @property
    def ends(self) -> np.ndarray:
        """The step after each character."""
        return self.gaps.cumsum(dtype=np.int64)

    def _places(self, steps: np.ndarray) -> np.ndarray:
        """The characters at ascending ``steps``."""
        out = [np.zeros(0, np.int64)]
        of = np.searchsorted(self.stretches, steps, "right")
        for k in np.unique(of).tolist():
            ends = self.gaps[k * STRETCH : (k + 1) * STRETCH].cumsum(dtype=np.int64) + (self.stretches[k - 1] if k else 0)
            out.append(np.searchsorted(ends, steps[of == k], "right") + k * STRETCH)
        return np.concatenate(out)

    def then(self, keep: int, text: str) -> Walk:
        return Walk(text, self, keep)

    @property
    def digits(self) -> np.ndarray:
        """Four bits for each sampled step of the walk."""
        if self._digits is None:
            steps = _sampled()[0]
            if not self.text:
                return steps[:0]
            at = self._places(steps[: np.searchsorted(steps, self.stretches[-1])]).tolist()
            second, first, here = (np.array([ord(self.text[i - back]) if i >= back else 0 for i in at], np.uint32) for back in (2, 1, 0))
            mix = (second * np.uint32(0x85EBCA77) + first) * np.uint32(0xC2B2AE3D) + here
            mix ^= mix >> np.uint32(15)
            self._digits = ((mix * np.uint32(0x27D4EB2F)) >> np.uint32(28)).astype(np.int64)
        return self._digits

    @property
    def fingerprint(self) -> str:
        return f"{len(self.digits)}:" + "".join(map("0123456789abcdef".__getitem__, self.digits.tolist()))


def read(fingerprint: str) -> np.ndarray:
    return np.array([int(x, 16) for x in fingerprint.partition(":")[2]], np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the sampled digits of two fingerprints, 0 to 1."""
    most, least = max(len(a), len(b)), min(len(a), len(b))
    if not most:
        return 1.0
    weights = _sampled()[1]
    share = weights[:least][a[:least] == b[:least]].sum() / weights[:most].sum()
    return float(max(0.0, (share - _CHANCE) / (1 - _CHANCE)))


def bands(digits: np.ndarray) -> list[str]:
    """Keys of the bands of the last ranges that the walk passes whole; short walks have one, of all digits."""
    full = len(digits) // SAMPLES
    if not full:
        return [f"-:{digits.tobytes().hex()}"]
    out = []
    for k in range(max(0, full - LAST_RANGES), full):
        part = digits[k * SAMPLES : (k + 1) * SAMPLES]
        out += [f"{k}.{i}:" + "".join(f"{x:x}" for x in part[i : i + BAND].tolist()) for i in range(0, SAMPLES, BAND)]
    return out


def _blocks(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt out in ranges of doc_id, one a partition and sorted; rows without one in ranges of a hash.

    The first document of a range also stands after the range before (ahead = 1), and the first of all
    after the last range.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [k / n for k in range(1, n)] or [0.5]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    at = rows.agg(*(F.percentile_approx(c, cuts, 10_000) for c in ("doc_id", "hash"))).first()  # shuffle.partitions numbers each
    bounds, hashes = sorted(set(at[0] or [])), sorted(set(at[1] or []))
    longs = lambda x: F.array(*(F.lit(v).cast("long") for v in x)).cast("array<bigint>")

    def upto(values: list[int], key: str) -> Column:
        """How many of the sorted ``values`` are not above the key; found in two steps."""
        width = 64
        count = lambda some: F.size(F.filter(some, lambda x: x <= F.col(key)))
        skip = count(longs(values[width - 1 :: width])) * width
        return skip + count(F.slice(longs(values), skip + 1, width))

    block = F.when(F.col("hash").isNull(), upto(bounds, "doc_id")).otherwise(upto(hashes, "hash") + len(bounds) + 1).cast("int")
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", "hash").alias("key"), block.alias("block"))
    first = {r.block: r.first for r in rows.groupBy("block").agg(F.min("key").alias("first")).collect()}  # a row a block
    used, blocks = sorted(first), len(bounds) + len(hashes) + 2
    if not used:
        return rows.withColumn("ahead", F.lit(0))
    previous = dict(zip(used[1:], used))
    leads = F.col("key") == F.get(longs(first.get(b) for b in range(blocks)), F.col("block"))
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("ahead"))
    before = F.struct(F.get(longs(previous.get(b) for b in range(blocks)), F.col("block")).cast("int").alias("block"), F.lit(1).alias("ahead"))
    after = F.struct(F.lit(used[-1]).alias("block"), F.lit(1).alias("ahead"))
    places = F.array(own, F.when(leads & (F.col("block") != used[0]), before), F.when(leads & (F.col("block") == used[0]), after))
    out = rows.select("doc_id", "text", "key", F.inline(F.filter(places, lambda x: x.isNotNull())))
    return out.repartitionById(blocks, F.col("block")).sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_last(), "key", "text")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, banded_edited boolean, banded_next boolean"


def _compared() -> Callable:
    def row(mine: tuple, following: tuple) -> tuple:
        doc_id, text, walk = mine
        _, after, next_walk = following
        keep = len(text) - len(text) // 4
        edit = after[: len(text) // 4]
        edited = walk.then(keep, edit)
        shares = [bool(set(bands(walk.digits)) & set(bands(x.digits))) for x in (edited, next_walk)]
        sha = hashlib.sha256()
        for at in range(0, len(edited.text), STRETCH):
            sha.update(edited.text[at : at + STRETCH].encode())
        return doc_id, len(text), sha.hexdigest(), walk.fingerprint, edited.fingerprint, likeness(walk.digits, edited.digits), likeness(walk.digits, next_walk.digits), *shares

    def run(batches):
        before = None
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        done = False
        for batch in (part for b in batches for part in common.slices(b, alone=common.SLICE_BYTES)):
            rows = []
            for doc_id, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                if done:
                    break
                mine = (doc_id, text, Walk(text))
                if before:
                    rows.append(row(before, mine))
                before, done = mine, bool(ahead)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k != "doc_id" else pa.array(c, pa.int64()) for k, c in zip(names, zip(*rows))], names)

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every document and of its edited text, and their likeness, a row for each document.

    docs needs doc_id and text.
    """
    return _blocks(docs.select("doc_id", "text")).mapInArrow(_compared(), _SCHEMA)


def _classes(prints: DataFrame) -> DataFrame:
    return prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))


def _block_pairs(least: float) -> Callable:
    """Like pairs of different components in each block of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("band", "ascending"), ("lo", "ascending"), ("hi", "ascending")]).combine_chunks()
        band = table.column("band").to_pylist()
        node, root, block, lo, hi = (table.column(c).to_numpy() for c in ("node", "root", "block", "lo", "hi"))
        prints = [read(x) for x in table.column("fingerprint").to_pylist()]
        n = np.array([len(x) for x in prints])
        digits = np.full((len(n), n.max()), -1, np.int8)
        for i, x in enumerate(prints):
            digits[i, : len(x)] = x
        weights = _sampled()[1][: n.max()]
        upto = np.r_[0.0, np.cumsum(weights)]
        begins = [i for i in range(len(n)) if not i or (band[i], lo[i], hi[i]) != (band[i - 1], lo[i - 1], hi[i - 1])]
        a, b, near = [], [], []
        for begin, end in zip(begins, [*begins[1:], len(n)]):
            for i in range(begin, end - 1):
                ok = root[i + 1 : end] != root[i]
                if lo[i] != hi[i]:
                    ok &= block[i + 1 : end] != block[i]
                at = i + 1 + np.flatnonzero(ok)
                equal = (digits[at, : n[i]] == digits[i, : n[i]]) @ weights[: n[i]]
                rough = (equal / upto[np.maximum(n[at], n[i])] - _CHANCE) / (1 - _CHANCE)
                for j in at[rough >= least - 1e-9].tolist():
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
                    near.append(likeness(prints[i], prints[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "near": pa.array(near, pa.float64())})

    return run


def near_pairs(prints: DataFrame, least: float = 0.6) -> DataFrame:
    """(a, b, near) for classes of equal fingerprints that share a band and are alike, by their smallest doc_id.

    prints needs doc_id and fingerprint. The pairs link all classes that any like pairs with a common band
    link; pairs inside what the smallest members of the buckets link already are left out.
    """
    count = prints.count()

    def banded(batches):
        for batch in batches:
            keys = [bands(read(x)) for x in batch.column("fingerprint").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fingerprint"), pa.array(keys, pa.list_(pa.string()))], ["doc_id", "fingerprint", "bands"])

    rows = common.written(_classes(prints).mapInArrow(banded, "doc_id long, fingerprint string, bands array<string>"), "bands", count)
    members = rows.select("doc_id", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a < last").drop("last")
    pairs = members.join(buckets, "band").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    side = lambda k: rows.select(F.col("doc_id").alias(k), F.col("fingerprint").alias(f"f{k}"))

    def verified(batches):
        for batch in batches:
            near = [likeness(read(x), read(y)) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.float64())], ["a", "b", "near"])

    stars = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(verified, "a long, b long, near double")
    stars = common.written(stars.where(F.col("near") >= least), "stars", count)

    roots = components(stars.select("a", "b"), count).withColumnRenamed("node", "doc_id")
    rooted = members.join(roots, "doc_id", "left").select("band", F.col("doc_id").alias("node"), F.coalesce("root", "doc_id").alias("root"))
    mixed = rooted.groupBy("band").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed = mixed.select("band", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    open_ = rooted.join(mixed, "band").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    open_ = common.written(open_.select("band", "node", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")), "open", count)
    groups = max(1, -(-open_.count() // (8 * BLOCK)))
    rest = (
        open_.join(rows.select(F.col("doc_id").alias("node"), "fingerprint"), "node")
        .groupBy(F.pmod(F.xxhash64("band", "lo", "hi"), F.lit(groups)).alias("g"))
        .applyInArrow(_block_pairs(least), "a long, b long, near double")
    )
    return stars.union(rest.where(F.col("near") >= least).distinct())


def near_groups(prints: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the same fingerprint) and group_id (smallest that ``near_pairs`` reach), a row for each row.

    Both are null where no row of the fingerprint has a doc_id.
    """
    roots = components(near_pairs(prints, least).select("a", "b"), prints.count()).withColumnRenamed("node", "class_id")
    classes = _classes(prints).withColumnRenamed("doc_id", "class_id").join(roots, "class_id", "left")
    return prints.select("doc_id", "fingerprint").join(classes, "fingerprint", "left").select("doc_id", "class_id", F.coalesce("root", "class_id").alias("group_id"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))
