r"""Ranked lexical search by windowed bucket scoring.

Terms are maximal runs of digits, letters and everything beyond ASCII, A-Z lower-cased. A term's weight,
a document's length factor and a score are in whole numbers (``weight``, ``search``), so results are the
same whatever the order of sums.

Index: tasks read whole texts and write, for each window of ``WINDOW`` neighbouring documents (fewer if
their postings exceed ``POSTINGS``), the postings of the query terms sorted by term, and all documents' numbers
of terms. Nothing is shuffled; document frequencies, N and L are sums over the written windows.

Search: windows are traversed one by one. For each query the postings of its terms are scattered into an
array with one sum for each document of the window, and into a bitset of the documents that are occupied;
only these are harvested, those above the least of the query's heap of ``k`` enter it, and only these
sums are cleared. A task gives at most ``k`` rows a query; these meet in two steps, by groups of tasks and then
by query.

Queries are taken in blocks whose terms have ``TERM_BYTES`` together (a single longer query is a block of its
own), so what is broadcast is bounded; the documents are read once for each block.

Defined results: null and empty texts have no terms - such documents are never found, such queries find nothing;
texts of any length are read whole, a piece at a time. Equal scores go by ascending doc_id, null last; every row
is a document of its own, so repeated rows stand beside each other. Queries equal in id and text are one; queries that
share an id only are ranked each by itself. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

K = 50
WINDOW, POSTINGS = 4096, 1 << 18
TERM_BYTES = 8 << 20
#: Groups of tasks whose best rows meet first.
GROUPS = 64
#: Bytes of one text whose terms are held at once.
PIECE = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def terms_of(text: str) -> Iterator[list[bytes]]:
    """All terms of a text, a list for each piece of it; pieces end where no term goes on."""
    data, at = text.encode().lower(), 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield _TERM.findall(data, at, end)
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


_WINDOW = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_WINDOW_SQL = "ids array<long>, lengths array<long>, terms array<int>, counts array<int>, docs array<int>, tfs array<int>"


class Index:
    """The window that is being filled."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.postings: list[tuple[np.ndarray, ...]] = []  # documents, terms, occurrences
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        own, n = [], 0
        for words in terms_of(text or ""):
            n += len(words)
            found = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
            own.append(np.unique(found[found >= 0], return_counts=True))
        if len(own) > 1:
            terms, at = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
            own = [(terms, np.bincount(at, np.concatenate([x for _, x in own]), len(terms)))]
        for terms, tfs in own:
            self.postings.append((np.full(len(terms), len(self.ids), np.int32), terms, tfs.astype(np.int32)))
            self.size += len(terms)
        self.ids.append(doc_id)
        self.lengths.append(n)

    def full(self) -> bool:
        return len(self.ids) >= WINDOW or self.size >= POSTINGS

    def row(self) -> pa.RecordBatch:
        """The window as one row; the next begins."""
        docs, terms, tfs = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (zip(*self.postings) if self.postings else ((), (), ())))
        order = np.lexsort((docs, terms))
        terms, counts = np.unique(terms, return_counts=True)
        cols = [self.ids, self.lengths, terms, counts.astype(np.int32), docs[order], tfs[order]]
        row = pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(cols, _WINDOW)], schema=_WINDOW)
        self.clear()
        return row


def _indexed(vocabulary) -> Callable:
    def run(batches):
        index = Index(vocabulary.value)
        for part in (part for batch in batches for part in common.slices(batch)):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                index.add(doc_id, text.as_py())
                if index.full():
                    yield index.row()
        if index.ids:
            yield index.row()

    return run


class Scores:
    """The sums of one window's documents, and the best of each query so far."""

    def __init__(self, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.queries, self.weights, self.n_docs, self.n_terms, self.k = queries, weights, n_docs, n_terms, k
        self.all = np.concatenate([np.zeros(0, np.int64), *queries])
        self.ends = np.cumsum([0, *map(len, queries)])
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in queries]  # (score, -doc_id), least first

    def window(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray) -> None:
        if not len(terms):
            return
        factor = 100 - 50 + (50 * lengths * self.n_docs) // self.n_terms
        adds = self.weights[np.repeat(terms, counts)] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * factor[docs]))
        upto = np.cumsum(counts)
        # the bitset of each term: words of 64 documents, those that are not empty
        word, bit, of = docs >> 6, np.uint64(1) << (docs & 63).astype(np.uint64), np.repeat(np.arange(len(terms)), counts)
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])])
        masks, words, word_upto = np.bitwise_or.reduceat(bit, first), word[first], np.cumsum(np.bincount(of[first], minlength=len(terms)))
        at = np.searchsorted(terms, self.all)
        known = terms[np.minimum(at, len(terms) - 1)] == self.all
        sums, occupied = np.zeros(len(ids), np.int64), np.zeros(len(ids) // 64 + 1, np.uint64)
        starts, word_starts = np.r_[0, upto[:-1]], np.r_[0, word_upto[:-1]]
        for q, heap in enumerate(self.heaps):
            own = slice(self.ends[q], self.ends[q + 1])
            for t in at[own][known[own]].tolist():
                sums[docs[starts[t] : upto[t]]] += adds[starts[t] : upto[t]]
                occupied[words[word_starts[t] : word_upto[t]]] |= masks[word_starts[t] : word_upto[t]]
            found = np.flatnonzero(np.unpackbits(occupied.view(np.uint8), bitorder="little"))
            if len(found):
                self.harvest(heap, ids[found], sums[found])
                sums[found] = 0
                occupied[:] = 0

    def harvest(self, heap: list[tuple[int, int]], ids: np.ndarray, scores: np.ndarray) -> None:
        least = heap[0][0] if len(heap) == self.k else 1
        able = scores >= least
        ids, scores = ids[able], scores[able]
        for i in np.lexsort((ids, -scores))[: self.k]:
            entry = (int(scores[i]), -int(ids[i]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                break


def _searched(held, k: int) -> Callable:
    def run(batches):
        queries, weights, n_docs, n_terms = held.value
        scores = Scores(queries, weights, n_docs, n_terms, k)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, terms, counts, docs, tfs = (batch.column(c)[i].values for c in _WINDOW.names)
                scores.window(ids.fill_null(common.LAST).to_numpy(zero_copy_only=False), *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lengths, terms, counts, docs, tfs)))
        rows = [(q, -d, s) for q, heap in enumerate(scores.heaps) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ()))], ["q", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> int:
    """In how many blocks by hash the queries go so that each has ``TERM_BYTES`` of terms or is one query."""
    n = 1
    while True:
        sizes = items.groupBy(F.pmod("hash", F.lit(n)).alias("block")).agg(F.sum("bytes").alias("bytes"), F.count_distinct("hash").alias("items"))
        if not sizes.where((F.col("bytes") > TERM_BYTES) & (F.col("items") > 1)).limit(1).count():
            return n
        n *= 2


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents (doc_id, text) of each query (item_id, text)."""
    spark = docs.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), 0))
    items = queries.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().select("item_id", terms.alias("terms"), F.xxhash64("item_id", "text").alias("hash"))
    items = common.written(items.where(F.size("terms") > 0).withColumn("bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)), "items")
    n_blocks, found = _blocks(items), None
    for block in range(n_blocks):
        own = items.where(F.pmod("hash", F.lit(n_blocks)) == block).select("item_id", "terms").collect()  # TERM_BYTES at most, or one query
        if not own:
            continue
        vocabulary = {x: i for i, x in enumerate(sorted({x.encode() for r in own for x in r.terms}))}
        index = docs.select("doc_id", "text").mapInArrow(_indexed(spark.sparkContext.broadcast(vocabulary)), _WINDOW_SQL)
        index = common.written(index, "index", None)
        sizes = index.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).collect()  # a row a term of the block
        weights = np.zeros(len(vocabulary), np.int64)
        for r in df:
            weights[r.terms] = weight(sizes.docs, r.df)
        of = [np.sort(np.array([vocabulary[x.encode()] for x in r.terms], np.int64)) for r in own]
        held = spark.sparkContext.broadcast((of, weights, sizes.docs, sizes.terms))
        best = index.mapInArrow(_searched(held, k), "q long, doc_id long, score long").withColumn("part", F.spark_partition_id() % GROUPS)
        by = [F.desc("score"), F.asc("doc_id")]
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("q", "part").orderBy(*by))).where(F.col("rank") <= k)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*by))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(own)], f"q long, item_id {queries.schema['item_id'].dataType.simpleString()}")
        best = best.join(F.broadcast(names), "q").select("item_id", "rank", F.when(F.col("doc_id") < common.LAST, F.col("doc_id")).alias("doc_id"), "score")  # a block's queries are bounded
        found = best if found is None else found.unionByName(best)
    if found is None:
        return queries.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = rf"""
WITH items AS MATERIALIZED (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS terms
  FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)
), asked AS MATERIALIZED (SELECT q, unnest(terms) AS term FROM items),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents
), sizes AS MATERIALIZED (SELECT r, doc_id, len(terms) AS n FROM docs),
total AS (SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
postings AS MATERIALIZED (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * t.docs + 2) / (2 * p.df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) p, total t
), scores AS (
  SELECT a.q, p.r, s.doc_id,
         CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * s.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM asked a JOIN postings p USING (term) JOIN weights w USING (term) JOIN sizes s ON s.r = p.r, total t
  GROUP BY a.q, p.r, s.doc_id
), ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS k
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (q) WHERE k <= {K}
"""
