r"""Quality rules with a hashed n-gram log-likelihood ratio; DataFrame functions only.

Base rules count words, their characters, symbols, repeated lines and words in repeated 3-word
windows; a document fails them with fewer than 50 words or with more than half of its words in
repeated windows.

The method: the last ``TAIL`` characters of each word, and of each two consecutive words, are hashed
to ``BUCKETS`` buckets. Two multinomials with add-one smoothing are counted over whole tables: the
target from the documents that ``labels`` trusts (quality 1, not toxic), the raw one from all
documents. A document's score is the mean over its n-grams of log P(target) - log P(raw). The
threshold is found once, from the histogram of the scores of all labelled documents: the middle of
the scores that best separate quality 1 from quality 0. Every document is then held against it;
nothing is drawn at random.

The model has a row for each bucket, a fixed number, so it is broadcast; counts combine on the map
side, so only buckets and one row a document are shuffled, never text.

Defined results: null and empty texts have no words and fail; without trusted documents no score
decides, and base rules alone do; without labelled documents of both kinds the threshold is 0 - that
is, as likely under the target as under the raw corpus - less a margin of ``MARGIN``; a score just at the threshold is
kept; very long texts are read whole; repeated rows
count as often as they stand there; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TAIL, BUCKETS = 3, 1 << 16
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 50, 3, 50
BIN, RANGE, MARGIN = 0.01, 2000, 1.0


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def _grams(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the two buckets, one and two, of each word of ``docs`` and of it with the next (null: none)."""
    words = docs.select(*keys, _words("text").alias("_words"))
    placed = words.select(*keys, "_words", F.posexplode("_words").alias("_at", "_word"))
    tail = lambda w: F.substring(w, -TAIL, TAIL)
    after = F.get(F.col("_words"), F.col("_at") + 1)
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    return placed.select(*keys, bucket(tail(F.col("_word"))).alias("one"), F.when(after.isNotNull(), bucket(tail(F.col("_word")), tail(after))).alias("two"))


#: Bits for a window's place in a document; of a text with more words all windows are compared.
PLACE_BITS = 24


def _packed(words: Column) -> Column:
    """The 3-word windows of a document as sorted longs: the hash's upper bits and the window's place."""
    n = F.greatest(F.size(words) - WINDOW + 1, F.lit(0))
    low = (1 << PLACE_BITS) - 1
    return F.sort_array(F.transform(F.slice(words, 1, n), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))


def _pairs(packed: Column) -> Column:
    """Places a, b of windows that may be twins: those whose hashes agree in all bits have become neighbours."""
    low = F.lit((1 << PLACE_BITS) - 1)
    near = F.filter(F.arrays_zip(packed.alias("a"), F.slice(packed, 2, F.greatest(F.size(packed) - 1, F.lit(0))).alias("b")), lambda p: F.shiftright(p["a"], PLACE_BITS) == F.shiftright(p["b"], PLACE_BITS))
    return F.transform(near, lambda p: F.struct(p["a"].bitwiseAND(low).cast("int").alias("a"), p["b"].bitwiseAND(low).cast("int").alias("b")))


def _unlike(words: Column, pairs: Column) -> Column:
    """Whether the hashes of a pair agree and its words do not."""
    same = lambda p, k: F.get(words, p["a"] + k) == F.get(words, p["b"] + k)
    return F.exists(pairs, lambda p: ~(same(p, 0) & same(p, 1) & same(p, 2)))


def _span(places: Column) -> Column:
    """Number of words in the windows at ``places``."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(i, i + WINDOW - 1)))))


def _covered(words: Column, places: Column) -> Column:
    """Number of words in the windows at ``places`` whose words really stand twice."""
    window = lambda i: [F.get(words, i + k).alias(f"w{k}") for k in range(WINDOW)]
    placed = F.sort_array(F.transform(places, lambda i: F.struct(F.struct(*window(i)).alias("w"), i.alias("i"))))
    none = F.array(F.lit(None).cast(f"struct<w:struct<{','.join(f'w{k}:string' for k in range(WINDOW))}>,i:int>"))
    after = F.concat(F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0))), none)
    rows = F.arrays_zip(placed.alias("at"), F.slice(F.concat(none, placed), 1, F.size(placed)).alias("before"), after.alias("after"))
    equal = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    twins = F.filter(rows, lambda r: equal(r["at"], r["before"]) | equal(r["at"], r["after"]))
    return _span(F.transform(twins, lambda r: r["at"]["i"]))


def base_rules(docs: DataFrame) -> DataFrame:
    """The base counts and base_failed for each row of ``docs`` (text non-null); keeps the other columns."""
    others = [c for c in docs.columns if c != "text"]
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{common.SPACE}]"))
    left = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    words = docs.select(
        *others,
        _words("text").alias("_words"),
        (F.length("text") - left("[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    packed = words.select("*", _packed(F.col("_words")).alias("_packed"))
    twins = packed.select("*", _pairs(F.col("_packed")).alias("_pairs"))
    few = F.size("_words") < (1 << PLACE_BITS)
    either = F.array_distinct(F.concat(F.transform("_pairs", lambda p: p["a"]), F.transform("_pairs", lambda p: p["b"])))
    # where a hash misleads, or places do not fit, the windows themselves are compared
    repeated = F.when(few & (F.size("_pairs") == 0), 0).when(few & ~_unlike(F.col("_words"), F.col("_pairs")), _span(either))
    repeated = repeated.otherwise(_covered(F.col("_words"), F.when(few, either).otherwise(F.sequence(F.lit(0), F.size("_words") - WINDOW))))
    out = twins.select(
        *others,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def ratio_model(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, bool]:
    """(bucket, ratio) for every bucket found, and whether any trusted document has words."""
    marked = docs.join(trusted.withColumn("trusted", F.lit(1)), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(0)).alias("trusted"))
    grams = _grams(marked, "trusted").select("trusted", F.explode(F.array("one", "two")).alias("bucket")).where("bucket is not null")
    counts = common.written(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")), "grams")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    share = lambda c, n: F.log(F.col(c) + 1.0) - F.lit(log((n or 0) + BUCKETS))
    return counts.select("bucket", (share("target", total.target) - share("raw", total.raw)).alias("ratio")), bool(total.target)


def threshold(labelled: DataFrame) -> float:
    """The middle of the best cut between quality 1 and 0, from a histogram of (score, quality) of fixed size."""
    bin_ = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-RANGE)), F.lit(RANGE)).cast("int")
    rows = {r.bin: r for r in labelled.groupBy(bin_.alias("bin")).agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad")).collect()}  # at most 2 * RANGE + 1
    good, bad = sum(r.good for r in rows.values()), sum(r.bad for r in rows.values())
    if not good or not bad:
        return -MARGIN
    best, cuts, lost, caught = None, [], 0, 0
    for cut in range(min(rows), max(rows) + 2):  # bins below the cut are refused
        value = caught / bad - lost / good
        if best is None or value > best:
            best, cuts = value, []
        if value == best:
            cuts.append(cut)
        if r := rows.get(cut):
            lost, caught = lost + r.good, caught + r.bad
    return BIN * (cuts[0] + cuts[-1]) / 2


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, score (null without words) and kept, a row for each document.

    docs needs doc_id and text; labels needs doc_id, quality and toxic.
    """
    rows = common.keyed(docs)
    labels = labels.where("doc_id is not null and quality is not null")
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("quality = 1 and toxic = 0").select("doc_id")
    model, any_trusted = ratio_model(rows, common.small(trusted, trusted.count(), 8))
    grams = _grams(rows, "_k", "_t")
    for c in ("one", "two"):  # every bucket of a document is in the model
        grams = grams.join(F.broadcast(model.select(F.col("bucket").alias(c), F.col("ratio").alias(f"ratio_{c}"))), c, "left")
    total = F.sum(F.col("ratio_one") + F.coalesce("ratio_two", F.lit(0.0))) / (F.count("ratio_one") + F.count("ratio_two"))
    scores = grams.groupBy("_k", "_t").agg(total.alias("score"))
    scores = common.written(scores, "scores", docs.count())
    cut = threshold(scores.join(labels.select(F.col("doc_id").alias("_k"), "quality"), "_k")) if any_trusted else float("-inf")
    out = base_rules(rows).join(scores, ["_k", "_t"], "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(cut), F.lit(False))).alias("kept"), "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
