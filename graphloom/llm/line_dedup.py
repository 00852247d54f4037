r"""Line dedup: delete later repeats of runs of lines, over the whole corpus.

Method: winnowing over line hashes (``repeats``): window minima are the anchors, equal anchors meet
by position, matches are extended both ways, and every run of at least ``gram + window - 1`` lines that
has an earlier occurrence goes. A line of ``long_words`` words or more is its own fingerprint and goes
alone if it stands anywhere before. Earlier means a smaller doc_id (null last), then a smaller place in
the same document. Lines end at \n, are compared without surrounding ASCII white space, and blank lines
are neither compared nor deleted.

Defined results: null or empty text has no lines; rows equal in doc_id and text count as one document;
a text that loses no line is returned as it is; very long texts are taken in stretches, a task holds
the text itself and the lines of one stretch; further columns called n_lines or n_removed give way to
the operator's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .repeats import Repeats

#: Runs of 2 lines at least: 2 grams of a line each; lines of so many words also alone.
GRAM, WINDOW, LONG_WORDS = 1, 2, 10
_BLANK = b" \t\r\x0b\x0c"


def _lines(text: bytes) -> list[bytes]:
    return [x for x in (line.strip(_BLANK) for line in text.split(b"\n")) if x]


def _left(text: bytes, lines: list[bytes], removed: np.ndarray) -> list[bytes]:
    if not removed.any():
        return [text]
    flags = iter(removed.tolist())
    return [line for line in text.split(b"\n") if not (line.strip(_BLANK) and next(flags))]


def _kept(n: int, gone: int, texts: Iterator[bytes]) -> dict:
    return {"n_lines": n, "n_removed": gone, "text": b"\n".join(texts)}


def line_dedup(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int | None = LONG_WORDS, stretch: int = common.SLICE_BYTES) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the text that stays, n_lines and n_removed; null text stays null.

    ``long_words`` None leaves single lines, however long; ``stretch`` is how many bytes of a text are taken at once.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rest = [c for c in names if c not in ("doc_id", "text")]
    long = (lambda line: len(line.split()) >= long_words) if long_words else None
    packed = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("no_text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))).alias("_rest"))
    keyed = common.keyed(packed, "_rest")
    kind = keyed.schema["_rest"].dataType.simpleString()
    out = Repeats(_lines, _left, re.compile(b"\n"), b"\n", gram, window, first_stays=True, long=long, stretch=stretch).marked(keyed, _kept, [("doc_id", "bigint"), ("text", "string"), ("n_lines", "bigint"), ("n_removed", "bigint"), ("_rest", kind)])
    text = F.when(~F.col("_rest.no_text"), F.col("text")).alias("text")
    by = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(rest)}
    return out.select(*(by[c] for c in names), F.col("n_lines"), F.col("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that stays (null: of the empty text)."""
    out = line_dedup(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, line, i, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), u AS (
  SELECT doc_id, i, t, row_number() OVER w AS p, lead(t) OVER w AS t2 FROM l WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, p) AS nth FROM u WHERE t2 IS NOT NULL
), long AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS nth FROM u WHERE len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) >= 10
), gone AS (
  SELECT r.doc_id, unnest(range(p, p + 2)) AS p FROM r WHERE nth > 1 UNION SELECT doc_id, p FROM long WHERE nth > 1
), f AS (
  SELECT l.doc_id, l.i, l.line, u.p IS NOT NULL AS counted, gone.p IS NOT NULL AS removed
  FROM l LEFT JOIN u USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.p = u.p
)
SELECT doc_id, count(*) FILTER (counted)::BIGINT AS n_lines, count(*) FILTER (removed)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
