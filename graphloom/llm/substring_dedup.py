"""Substring dedup: remove every word of a run of words that occurs more than once in the corpus.

Method: seed and extend (``repeats``): documents meet on winnowed word anchors, matches are extended both
ways, and maximal repeats over the threshold go. Words are the byte strings between
ASCII white space, unchanged. Defined results: null or empty text has no words; repeated rows are
documents of their own, so their runs count as repeats, and of equal runs none is preferred, all go; very long texts
are taken in stretches, a task holds the text itself and the words of one stretch; rows may have any further columns, which
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common
from .repeats import Repeats

#: A repeat has 35 words at least: 24 grams of 12 words.
GRAM, WINDOW = 12, 24


def _words(text: bytes, words: list[bytes], removed: np.ndarray) -> list[bytes]:
    return [w for w, r in zip(words, removed.tolist()) if not r] if removed.any() else words


def _kept(n: int, gone: int, texts: Iterator[bytes]) -> dict:
    return {"n_words": n, "n_removed": gone, "kept": b" ".join(texts)}


def _digest(n: int, gone: int, texts: Iterator[bytes]) -> dict:
    sha = hashlib.sha256(next(texts, b""))
    for text in texts:
        sha.update(b" ")
        sha.update(text)
    return {"n_words": n, "n_removed": gone, "kept_sha256": sha.hexdigest()}


def substring_dedup(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, digest: bool = False, stretch: int = common.SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by a space (``digest``: their SHA-256).

    docs needs doc_id and text. Runs of ``gram + window - 1`` words are the shortest repeats; ``stretch`` is how many bytes of a text are
    taken at once.
    """
    last = ("kept_sha256" if digest else "kept", "string")
    return Repeats(bytes.split, _words, common.BLANK, b" ", gram, window, first_stays=False, stretch=stretch).marked(common.keyed(docs), _digest if digest else _kept, [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), last])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.documents(spark, sf_dir), digest=True)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), d AS (
  SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM d
), gl AS (
  SELECT doc_id, list(j) AS js, count(*) AS n FROM g GROUP BY doc_id
), k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.j) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) x
  LEFT JOIN g USING (doc_id, j) WHERE g.j IS NULL GROUP BY x.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gl.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN gl USING (doc_id) LEFT JOIN k USING (doc_id)
"""
