r"""Language ID by prediction by partial matching (PPM) over bytes.

For each language a variable-order context tree of bytes is counted on labelled texts and then frozen.
The probability of a byte after a context is PPM-C with exclusions: with n occurrences of the context
and d different bytes after it, a seen byte has count / (n + d), the escape has d / (n + d), and the rest
goes to the shorter context without the bytes already seen; the shortest is uniform over all 256 bytes.
A text's code length is the exact sum over all its bytes, and the language with the shortest one (plus
that of the language's share of the learning rows) wins.

Since the statistics are frozen, the tree is kept as hashed tables of the grams that the sample holds:
the code length of a seen gram, and of each context the cost of escaping from it. A byte's code length is
that of the longest seen gram that ends with it plus the escapes of the contexts passed on the way. A
language's tables grow with its sample alone, and ``ORDER`` is the same for any number of languages. Texts
are scored a chunk at once: the tables are asked for each different gram of the chunk.

Bytes are those of UTF-8 with A-Z lower-cased; each of the 256 values is a symbol of its own.

Learning: per language the documents with the smallest hashes of doc_id and text, up to ``SAMPLE_BYTES`` bytes
of text a language - a bounded sample, the same in each run. It is looked for in one bucket of the hashes, and in
wider ones where few different documents fall there, so no language is missed. The ``LANGUAGES`` with the most rows
are learned (ties by name), which bounds the model. Prediction reads every byte of every text.

score is the posterior of the predicted language with code lengths taken for each ``EVIDENCE`` bytes
at most (else it would be 1 for every longer text), in 0 to 1. A text is ``und`` with score 0 if it is
null or has no letter. ``bits`` is the code length a byte.

Ties: of equal code lengths the language first by name wins. Very long texts are scored in chunks, whole.

Defined results: null and empty texts are ``und``; without any learning row every text is ``und``; rows with a
null lang or doc_id are not learned from; further columns are ignored; repeated rows count twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

ORDER, SYMBOLS = 3, 256
SAMPLE_BYTES = 400_000
LANGUAGES = 512
EVIDENCE = 40
#: Bytes of text that are scored at once in a task.
CHUNK = 1 << 20
#: The byte that stands before a text, ORDER times.
LEAD = b"\n"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; null is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Index:
    """Places of numbers in ``keys`` (distinct), for whole arrays of them at once.

    A hash table with one key a slot; keys whose slot is taken are in a smaller table of their own.
    """

    def __init__(self, keys: np.ndarray):
        self.n, self.kind = len(keys), keys.dtype.type
        self.width = 8 * keys.dtype.itemsize
        self.bits = max(1, int(4 * len(keys)).bit_length())
        slot = self._slot(keys)
        first = np.sort(np.unique(slot, return_index=True)[1])
        self.keys, self.places = np.zeros(1 << self.bits, keys.dtype), np.full(1 << self.bits, self.n, np.int32)
        self.keys[slot[first]], self.places[slot[first]] = keys[first], first
        self.rest = np.setdiff1d(np.arange(self.n), first)
        self.shared = np.zeros(1 << self.bits, bool)
        self.shared[slot[self.rest]] = True
        self.more = Index(keys[self.rest]) if len(self.rest) else None

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x * self.kind(0x9E3779B97F4A7C15 & ((1 << self.width) - 1))) >> self.kind(self.width - self.bits)

    def find(self, x: np.ndarray) -> np.ndarray:
        """For each of ``x`` its place in the keys, or their number if it is none of them."""
        slot = self._slot(x)
        out = np.where(self.keys[slot] == x, self.places[slot], np.int32(self.n))
        if self.more:
            left = np.flatnonzero((out == self.n) & self.shared[slot])
            at = self.more.find(x[left])
            out[left] = np.where(at < self.more.n, np.r_[self.rest, 0][at], self.n)
        return out


@dataclass(frozen=True)
class Level:
    """Grams of one length: code lengths of their last byte, and what escaping from each as a context costs.

    Both end with an entry for grams that were not seen: escaping from such a context costs nothing.
    """

    grams: np.ndarray
    index: Index
    bits: np.ndarray
    escape: np.ndarray


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    order: int
    levels: tuple[tuple[Level, ...], ...]  # of each language, grams of one byte first
    unseen: tuple[float, ...]  # of each language, code length of a byte that its sample lacks
    grams: np.ndarray  # the longest ones of all languages
    index: Index  # of these
    prior: np.ndarray  # code length of each language


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grams(data: np.ndarray, length: int, order: int) -> np.ndarray:
    """The gram of ``length`` bytes that ends with each byte, as a number; ``data`` begins with ``order`` bytes of context."""
    kind = np.uint32 if order <= 3 else np.uint64
    n = len(data) - order
    out = np.zeros(n, kind)
    for j in range(order + 1 - length, order + 1):
        out = (out << kind(8)) | data[j : j + n]
    return out


def _tail(grams: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of each gram."""
    return grams & grams.dtype.type((1 << 8 * length) - 1)


def tree(data: np.ndarray, order: int) -> tuple[tuple[Level, ...], float]:
    """The frozen context tree of one sequence of lower-cased bytes with a lead, and the code length of an unseen byte."""
    data = np.concatenate([np.full(2 * order, LEAD[0], np.uint8), data])
    low = np.full(SYMBOLS, 1 / SYMBOLS)  # probabilities by shorter contexts, of the grams of the level below
    levels, below, uniform = [], None, 1 / SYMBOLS
    for k in range(order + 1):
        keys, counts = np.unique(_grams(data, k + 1, order), return_counts=True)
        kind = keys.dtype.type
        context = keys >> kind(8)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))  # number of each gram's context
        total, kinds = np.add.reduceat(counts, first), np.diff(np.r_[first, len(keys)])
        shorter = low[keys.astype(np.int64)] if below is None else low[below.find(_tail(keys, k))]
        mass = 1 - np.add.reduceat(shorter, first)
        full = (kinds == SYMBOLS) | (mass < 1e-12)  # every byte was seen: nothing to escape to
        p = counts / np.where(full, total, total + kinds)[of]
        factor = np.where(full, 1.0, kinds / (total + kinds) / np.maximum(mass, 1e-300))
        if below is None:
            uniform *= factor[0]
        else:  # contexts are grams of the level below
            levels[-1].escape[below.find(context[first])] = -np.log2(factor)
        index = Index(keys)
        levels.append(Level(keys, index, np.r_[-np.log2(p), 0.0].astype(np.float32), np.zeros(len(keys) + 1, np.float32)))
        low, below = np.r_[p, 0.0], index
    return tuple(levels), float(-np.log2(uniform))


def fit(texts: dict[str, bytes], rows: dict[str, int], order: int = ORDER) -> Model:
    """``texts`` of each language, joined, and how many rows each has in all; texts without a byte teach nothing."""
    langs = tuple(sorted(x for x in texts if texts[x]))
    trees = [tree(_LOWER[np.frombuffer(texts[x], np.uint8)], order) for x in langs]
    total = sum(rows[x] for x in langs)
    grams = np.unique(np.concatenate([t[-1].grams for t, _ in trees])) if trees else np.zeros(0, np.uint32)
    return Model(langs, order, tuple(t for t, _ in trees), tuple(u for _, u in trees), grams, Index(grams), np.array([-np.log2(rows[x] / total) for x in langs]))


def gram_bits(model: Model, grams: np.ndarray) -> list[np.ndarray]:
    """For each language the bits of each gram's last byte after the ``order`` bytes before it."""
    out = []
    for levels, unseen in zip(model.levels, model.unseen):
        bits = np.full(len(grams), unseen, np.float32)
        for k, level in enumerate(levels):
            if k:
                shorter = levels[k - 1]
                bits += shorter.escape[shorter.index.find(_tail(grams >> grams.dtype.type(8), k))]
            at = level.index.find(_tail(grams, k + 1))
            bits = np.where(at < len(level.grams), level.bits[at], bits)
        out.append(bits)
    return out


def code_lengths(model: Model, data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bits of different grams in each language, and which of them each byte ends.

    ``data`` is lower-cased and begins with ``order`` bytes of context.
    """
    grams = _grams(data, model.order + 1, model.order)
    at = model.index.find(grams)
    new = np.flatnonzero(at == len(model.grams))
    known = np.flatnonzero(np.bincount(at, minlength=len(model.grams) + 1)[:-1])
    others, place = np.unique(grams[new], return_inverse=True)
    rank = np.zeros(len(model.grams) + 1, np.int32)
    rank[known] = np.arange(len(known))
    which = rank[at]
    which[new] = len(known) + place
    return gram_bits(model, np.concatenate([model.grams[known], others])), which


def lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Code length in bits of each text in each language. Short texts are scored together, long ones in chunks."""
    out = np.zeros((len(texts), len(model.langs)))
    lead = LEAD * model.order

    def score(parts: list[bytes], of: list[int]) -> None:
        """``parts`` each begin with their context."""
        data = _LOWER[np.frombuffer(b"".join(parts), np.uint8)]
        bits, which = code_lengths(model, data)
        ends = np.cumsum([len(x) for x in parts]) - model.order
        # the sums of a part leave out the context of the one that follows
        edges = np.ravel(np.column_stack([np.r_[0, ends[:-1] + model.order], ends]))
        for lang, own in enumerate(bits):
            np.add.at(out[:, lang], of, np.add.reduceat(np.r_[own[which], np.float32(0)], edges, dtype=np.float64)[::2])

    parts, of, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            parts.append(lead + text[:CHUNK] if not at else (lead + text)[at : at + CHUNK + model.order])
            of.append(i)
            size += len(parts[-1])
            if size >= CHUNK:
                score(parts, of)
                parts, of, size = [], [], 0
    if parts:
        score(parts, of)
    return out


def has_letter(text: str) -> bool:
    first = _MAYBE_LETTER.search(text)
    return bool(first) and (first[0].isalpha() or any(map(str.isalpha, text)))


def _predict(model: Model, names: list[str]) -> Callable:
    def run(batches):
        for batch in (part for b in batches for part in common.slices(b)):
            texts = batch.column("text").to_pylist()
            known = [i for i, x in enumerate(texts) if x and model.langs and has_letter(x)]
            data = [texts[i].encode() for i in known]
            lang, score, bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if known:
                size = np.array([len(x) for x in data])[:, None]
                code = lengths(model, data)
                total = code + model.prior
                best = total.argmin(axis=1)
                gap = (total - total.min(axis=1, keepdims=True)) * np.minimum(1, EVIDENCE / size)
                sure = 1 / np.exp2(-gap).sum(axis=1)
                for i, b, s, c in zip(known, best, sure, code.min(axis=1) / size[:, 0]):
                    lang[i], score[i], bits[i] = model.langs[b], float(s), float(c)
            made = {"lang_pred": pa.array(lang), "score": pa.array(score, pa.float64()), "bits": pa.array(bits, pa.float64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)

    return run


def learned(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, languages: int = LANGUAGES) -> Model:
    """The frozen model of the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & ~held_out())
    rows = rows.select("lang", F.xxhash64("doc_id").alias("order"), F.xxhash64("doc_id", "text").alias("hash"), F.octet_length("text").cast("long").alias("bytes"), "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).orderBy(F.desc("rows"), "lang").limit(languages).collect()
    # One hash bucket of so many holds about twice the sample of a language, and 50 documents at least.
    share = {r.lang: max(1, min(r.bytes // (2 * sample_bytes), r.rows // 50)) for r in counts}
    texts: dict[str, bytes] = {}
    while share:
        widest = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
        copies = rows.where(F.pmod("hash", widest) == 0).groupBy("lang", "order", "hash", "bytes", "text").agg(F.count("*").alias("copies"))
        copies = copies.withColumn("copies", F.least("copies", F.ceil(F.lit(sample_bytes) / F.col("bytes"))))  # of one text so many at most
        upto = F.sum(F.col("bytes") * F.col("copies")).over(W.partitionBy("lang").orderBy("hash", "text"))
        picked = copies.withColumn("before", upto - F.col("bytes") * F.col("copies")).where(F.col("before") < sample_bytes)
        picked = picked.select("lang", "order", "copies", F.substring("text", 1, sample_bytes).alias("text")).collect()  # bounded by languages x sample
        own: dict[str, bytes] = {}
        for r in sorted(picked, key=lambda r: (r.lang, r.order, r.text)):
            own[r.lang] = own.get(r.lang, b"") + (r.text.encode() + b"\n") * r.copies
        texts |= {x: own[x] for x in share if share[x] == 1 or len(own.get(x, b"")) >= sample_bytes}
        share = {x: max(1, n // 16) for x, n in share.items() if x not in texts}
    return fit(texts, {r.lang: r.rows for r in counts})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and bits; text is the only input of a prediction."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "bits")]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    held = docs.sparkSession.sparkContext.broadcast(model)  # grows with the sample alone, by about 15 bytes for each of its grams
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double, bits double"

    def run(batches):
        yield from _predict(held.value, [*names, "lang_pred", "score", "bits"])(batches)

    return kept.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = identify(docs.select("doc_id", "text"), learned(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")
