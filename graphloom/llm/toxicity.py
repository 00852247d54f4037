r"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is a sequence of units: lower-cased words, those of more than ``UNIT_CHARS`` characters in pieces.
A unit's input is the embedding of its word without signs around it (words in fewer than ``WORD_DOCS``
learning texts share one) beside the mean embedding of its hashed character trigrams. Windows of ``LENGTH``
units begin at every ``STRIDE``-th, so they overlap and cover every unit. One gated recurrent network reads a
window forwards, one backwards; attention pools their states, and a logit follows. A text's logit is that of
its most toxic window.

Learning: a bounded sample of labelled rows, those with the smallest hashes of doc_id, ``ROWS`` of either label,
among texts of up to ``TEXT_BYTES``; rows whose crc32(doc_id as text) mod 5 is 0 are never learned from. Each
batch scores all windows of its texts and follows the gradient of each text's most toxic window (labels say nothing
about places), and for texts that are not toxic also of the first unit of that window, repeated: repetition is no sign. At the end the intercept is moved from the sample's share of toxic rows to that of all rows learned from.
Everything is seeded, so a model follows from its sample.

Scoring: every window of every whole text. Projections of a unit's input are kept by unit, and all windows of
a slice take a step at once. Long texts go through a block at a time.

Defined results: null and empty texts, and texts without a unit, have the share of toxic rows as score (0 if nothing was
labelled); so do all texts if only one label was seen. Rows with a null label or doc_id teach nothing. Ties: a score of just 0.5
is predicted 1. Repeated rows have equal scores; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, STRIDE = 20, 12
UNIT_CHARS = 24
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 12, 12, 12, 8
CHAR_BUCKETS, WORD_DOCS = 1 << 13, 5
ROWS, TEXT_BYTES = (1600, 800), 64_000  # not toxic, toxic
EPOCHS, BATCH, RATE, SEED = 9, 32, 0.01, 7
#: Weight of a repeated unit beside that of a text.
REPEATED = 0.2
#: Characters of a text that are cut into units at once, windows that step at once, units whose projections are kept.
BLOCK, STEP, KEPT = 1 << 20, 4096, 100_000
_UNIT = re.compile(rf"[^\x20\x09-\x0D]{{1,{UNIT_CHARS}}}")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_SIGNS = re.compile(r"^[\W_]+|[\W_]+$")
_FULL = np.float32(30)  # an update gate with this in it keeps the state


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text is divisible by 5; null is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def units_of(text: str) -> Iterator[list[str]]:
    """The units of a text, a list for each block; blocks end at white space."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        yield _UNIT.findall(text[at:end].lower())
        at = end


def window_starts(n: int, first: bool = True, last: bool = True) -> range:
    """Where windows begin in ``n`` units that follow others (not ``first``) or are followed by others (not ``last``)."""
    if not last:
        return range(0, max(0, n - LENGTH + 1), STRIDE)
    return range(0, max(1 if first and n else 0, n - (LENGTH - STRIDE)), STRIDE)


@dataclass
class Features:
    """Inputs of different units: word numbers, and trigram buckets one unit after the other."""

    words: np.ndarray
    trigrams: np.ndarray
    counts: np.ndarray


def features(units: list[str], vocabulary: dict[str, int]) -> Features:
    words = np.fromiter((vocabulary.get(_core(x), 0) for x in units), np.int64, len(units))
    counts = np.array([len(x) for x in units], np.int64)
    codes = np.frombuffer("".join(f" {x} " for x in units).encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:] * np.uint64(0x165667B19E3779F9)) if len(units) else codes
    inside = np.repeat(np.cumsum(counts + 2) - counts - 2, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    trigrams = ((hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64)[inside] % CHAR_BUCKETS
    return Features(words, trigrams, counts)


def _gate(x: np.ndarray) -> np.ndarray:
    out = np.tanh(0.5 * x)
    out += 1
    out *= 0.5
    return out


def _core(unit: str) -> str:
    """A unit without signs around it."""
    return unit if unit.isalnum() else _SIGNS.sub("", unit)


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` sums of the rows with each index."""
    out, order = np.zeros((n, rows.shape[1]), np.float32), np.argsort(index, kind="stable")
    if len(order):
        index = index[order]
        first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        out[index[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class Network:
    """Parameters by name; gates of a direction stand in the order update, reset, candidate."""

    def __init__(self, n_words: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        n = WORD_DIM + CHAR_DIM
        self.p = {"word": draw(n_words, WORD_DIM, by=0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM, by=0.1), "to": draw(2 * HIDDEN, ATTENTION, by=0.3), "to0": np.zeros(ATTENTION, np.float32), "ask": draw(ATTENTION, by=0.3), "out": draw(2 * HIDDEN, by=0.3), "out0": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(n, 3 * HIDDEN, by=n**-0.5), f"u{d}": draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, f: Features) -> np.ndarray:
        if not len(f.words):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        starts = np.cumsum(f.counts) - f.counts
        chars = np.add.reduceat(self.p["char"][f.trigrams], starts, axis=0) / f.counts[:, None]
        return np.concatenate([self.p["word"][f.words], chars], axis=1).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What inputs give to the gates of both directions; row 0 stands for no unit and keeps the state."""
        out = np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)
        none = np.zeros((1, out.shape[1]), np.float32)
        none[0, :HIDDEN] = none[0, 3 * HIDDEN : 4 * HIDDEN] = _FULL
        return np.concatenate([none, out]).astype(np.float32)

    def forward(self, projected: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: rows of ``projected`` at each place, 0 for none. ``keep`` gets what ``backward`` needs."""
        n, length, h = len(at), at.shape[1], HIDDEN
        states = np.zeros((length, n, 2 * h), np.float32)
        for k, d in enumerate("fb"):
            state, u, steps = np.zeros((n, h), np.float32), self.p[f"u{d}"], []
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                x, own = projected[at[:, t], 3 * h * k : 3 * h * (k + 1)], state @ u
                gates = _gate(x[:, : 2 * h] + own[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                candidate = np.tanh(x[:, 2 * h :] + r * own[:, 2 * h :])
                before, state = state, candidate + z * (state - candidate)
                states[t, :, h * k : h * (k + 1)] = state
                if keep is not None:
                    steps.append((t, before, z, r, candidate, own[:, 2 * h :]))
            if keep is not None:
                keep[d] = steps
        hidden = np.tanh(states @ self.p["to"] + self.p["to0"])
        weights = _softmax(np.where(at > 0, (hidden @ self.p["ask"]).T, np.float32(-1e9)))
        pooled = np.einsum("nt,tnh->nh", weights, states)
        if keep is not None:
            keep |= {"states": states, "hidden": hidden, "weights": weights, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out0"][0]

    def backward(self, f: Features, x: np.ndarray, at: np.ndarray, keep: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by parameter, ``slope`` being that of the loss by each logit."""
        h, states, weights, hidden = HIDDEN, keep["states"], keep["weights"], keep["hidden"]
        g = {"out": keep["pooled"].T @ slope, "out0": np.array([slope.sum()])}
        d_pooled = slope[:, None] * self.p["out"]
        d_weights = np.einsum("nh,tnh->nt", d_pooled, states)
        d_energy = weights * (d_weights - (weights * d_weights).sum(axis=1, keepdims=True))
        d_hidden = d_energy.T[:, :, None] * self.p["ask"] * (1 - hidden**2)
        g |= {"ask": np.einsum("nt,tna->a", d_energy, hidden), "to": np.einsum("tnh,tna->ha", states, d_hidden), "to0": d_hidden.sum(axis=(0, 1))}
        d_states = weights.T[:, :, None] * d_pooled + d_hidden @ self.p["to"].T
        places, slopes = [], []
        for k, d in enumerate("fb"):
            u, back = self.p[f"u{d}"], np.zeros((len(at), h), np.float32)
            g |= {f"w{d}": np.zeros_like(self.p[f"w{d}"]), f"u{d}": np.zeros_like(u), f"c{d}": np.zeros(3 * h, np.float32)}
            for t, before, z, r, candidate, own in reversed(keep[d]):
                back = back + d_states[t, :, h * k : h * (k + 1)]
                d_c = back * (1 - z) * (1 - candidate**2)
                d_z, d_r = back * (before - candidate) * z * (1 - z), d_c * own * r * (1 - r)
                pre, into = np.concatenate([d_z, d_r, d_c], axis=1), np.concatenate([d_z, d_r, d_c * r], axis=1)
                real = at[:, t] > 0
                g[f"u{d}"] += before.T @ into
                g[f"w{d}"] += x[at[real, t] - 1].T @ pre[real]
                g[f"c{d}"] += pre[real].sum(axis=0)
                places.append(at[real, t] - 1)
                slopes.append(pre[real] @ self.p[f"w{d}"].T)
                back = back * z + into @ u.T
        d_x = _sums(np.concatenate(places), np.concatenate(slopes), len(x))
        g["word"] = _sums(f.words, d_x[:, :WORD_DIM], len(self.p["word"]))
        g["char"] = _sums(f.trigrams, np.repeat(d_x[:, WORD_DIM:] / np.maximum(f.counts, 1)[:, None], f.counts, axis=0), CHAR_BUCKETS)
        return g


@dataclass
class Model:
    network: Network | None
    vocabulary: dict[str, int]
    share: float


def windows(n: int, first: bool = True, last: bool = True) -> np.ndarray:
    """Places of the units of each window, from 1; 0 beyond the end."""
    at = np.array(window_starts(n, first, last), np.int64)[:, None] + np.arange(1, LENGTH + 1)
    return np.where(at <= n, at, 0)


def fit(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS) -> Model:
    """The network of labelled texts; ``share`` of all rows is toxic."""
    units = [[x for part in units_of(text) for x in part] for text in texts]
    known = [i for i, x in enumerate(units) if x]
    if len({labels[i] for i in known}) < 2:
        return Model(None, {}, share)
    units, labels = [units[i] for i in known], np.array([labels[i] for i in known], np.float32)
    held = Counter(w for own in units for w in {_core(x) for x in own})
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, n in held.items() if n >= WORD_DOCS))}
    rank = {x: i for i, x in enumerate(sorted({x for own in units for x in own}))}
    every = features(list(rank), vocabulary)
    starts = np.cumsum(every.counts) - every.counts
    ids = [np.array([rank[x] for x in own], np.int64) for own in units]
    network, rng, step = Network(len(vocabulary) + 1), np.random.default_rng(SEED), 0
    first, second = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2))
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            at = [windows(len(ids[i])) for i in batch]
            mine = np.repeat(np.arange(len(batch)), [len(x) for x in at])
            at = np.concatenate([np.where(x > 0, ids[i][x - 1] + 1, 0) for i, x in zip(batch, at)])
            used, place = np.unique(at, return_inverse=True)
            place = place.reshape(at.shape) + (used[0] > 0)
            used = used[used > 0] - 1
            f = Features(every.words[used], np.concatenate([every.trigrams[starts[i] : starts[i] + every.counts[i]] for i in used]), every.counts[used])
            x = network.inputs(f)
            projected = network.projected(x)
            logits = np.concatenate([network.forward(projected, place[i : i + STEP]) for i in range(0, len(place), STEP)])
            ranked = np.lexsort((-logits, mine))
            top = ranked[np.flatnonzero(np.diff(mine[ranked], prepend=-1))]
            clean = top[labels[batch] == 0]
            taken, keep = np.concatenate([place[top], np.repeat(place[clean, 0][:, None], LENGTH, axis=1)]), {}
            target = np.concatenate([labels[batch], np.zeros(len(clean), np.float32)])
            out = network.forward(projected, taken, keep)
            share_of = np.where(np.arange(len(target)) < len(batch), 1, REPEATED) / len(batch)
            g = network.backward(f, x, taken, keep, ((_gate(out) - target) * share_of).astype(np.float32))
            step += 1
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                network.p[k] -= (RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    odds = lambda s: np.log(s / (1 - s))
    low = 0.5 / (len(labels) + 1)
    network.p["out0"] = (network.p["out0"] + odds(np.clip(share, low, 1 - low)) - odds(labels.mean())).astype(np.float32)
    return Model(network, vocabulary, share)


class Scorer:
    """The model with the projections of units met so far; one in each worker."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rank: dict[str, int] = {}
        self.projected = self.model.network.projected(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))

    def ids(self, units: list[str]) -> np.ndarray:
        """Rows of ``projected`` for units."""
        new = [x for x in dict.fromkeys(units) if x not in self.rank]
        if new and len(self.rank) + len(new) > KEPT:
            self.clear()
            new = list(dict.fromkeys(units))
        if new:
            self.rank.update(zip(new, range(len(self.projected), len(self.projected) + len(new))))
            own = self.model.network.projected(self.model.network.inputs(features(new, self.model.vocabulary)))
            self.projected = np.concatenate([self.projected, own[1:]])
        return np.fromiter(map(self.rank.__getitem__, units), np.int64, len(units))

    def block(self, parts: list[tuple[int, list[str], bool, bool]], best: np.ndarray) -> None:
        """Raise ``best`` of each text to the logit of its most toxic window among ``parts``."""
        ids = self.ids([x for _, units, _, _ in parts for x in units])
        ends = np.cumsum([len(units) for _, units, _, _ in parts])
        at = [windows(len(units), first, last) for _, units, first, last in parts]
        of = np.repeat([k for k, _, _, _ in parts], [len(x) for x in at])
        at = np.concatenate([np.where(x > 0, x + end - len(units), 0) for x, end, (_, units, _, _) in zip(at, ends, parts)])
        at = np.where(at > 0, ids[at - 1], 0) if len(ids) else at
        for i in range(0, len(at), STEP):
            np.maximum.at(best, of[i : i + STEP], self.model.network.forward(self.projected, at[i : i + STEP]))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        parts, size = [], 0
        for k, text in enumerate(texts if self.model.network else ()):
            tail, first, blocks = [], True, units_of(text or "")
            units = next(blocks, None)
            while units is not None:
                units, after = tail + units, next(blocks, None)
                parts.append((k, units, first, after is None))
                size += len(units)
                if after is not None:
                    done = len(window_starts(len(units), first, False)) * STRIDE
                    tail, first = units[done:], first and not done
                units = after
                if size * 6 > BLOCK:
                    self.block(parts, best)
                    parts, size = [], 0
        if parts:
            self.block(parts, best)
        return np.where(np.isinf(best), self.model.share, _gate(best))


def _scored(held, names: list[str]) -> Callable:
    def run(batches):
        scorer = Scorer(held.value) if held.value.network else None
        for part in (part for batch in batches for part in common.slices(batch)):
            texts = part.column("text").to_pylist()
            scores = scorer.scores(texts) if scorer else np.full(len(texts), held.value.share)
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()) if n == "score" else part.column(n) for n in names], names)

    return run


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), from a bounded sample of rows that are not held out."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id"))
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n = sum(counts.values())
    picked = None
    for toxic in (0, 1):  # twice the rows, as some have no text or a long one
        own = rows.where(F.col("toxic") == toxic).orderBy("hash", "doc_id").limit(2 * ROWS[toxic])
        own = docs.select("doc_id", "text").where(F.octet_length("text") <= TEXT_BYTES).join(F.broadcast(own), "doc_id")
        own = own.orderBy("hash", F.xxhash64("text")).limit(ROWS[toxic]).select("text", "toxic")
        picked = own if picked is None else picked.unionByName(own)
    sample = sorted((r.text, r.toxic) for r in picked.collect())
    return fit([x for x, _ in sample], [y for _, y in sample], counts.get(1, 0) / n if n else 0.0)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text) with score and predicted; the text is the only input."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the learning sample
    return kept.mapInArrow(_scored(held, [*names, "score"]), f"{schema}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = score_toxicity(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
