r"""Secret scans by corpus-wide ownership frequency; DataFrame functions only.

Base kinds, leftmost and non-overlapping within a kind, over the whole text (null: empty):
assign (a secret's name, ``=`` or ``:`` and a value of 12 or more characters), access (``AKIA`` keys of
18 or more) and hex (runs of 16 or more). Spans are ``kind:start:end`` in code points, end exclusive.

The method: every base value and every mixed token (20 or more characters of ``[A-Za-z0-9+/_-]`` with a
digit, an upper and a lower letter) is a candidate. Candidates are hashed where they are found - plain
values are never written - and their hashes are counted over the corpus by distinct owners and distinct
repositories. A value that ``COPIED_OWNERS`` owners hold, or two owners in ``COPIED_REPOSITORIES``
repositories, is a copied example, however it looks; one of fewer holders - of a single owner in any number of
repositories - that looks random (enough different characters, no placeholder word) is live. Live values add a span ``live:start:end``;
base spans stay. n_owners and n_repositories tell the most that any value of the document has.

Positions are running sums over the gaps (``split`` on the pattern) and the matches
(``regexp_extract_all``), one row a match, so the work is linear in a text's matches. Counts combine
before their shuffle; verdicts meet their candidates by hash, and hashes with more than ``HOT_ROWS``
candidates (at most ``HOT_HASHES`` of them, broadcast) are dealt out to several tasks.

Defined results: rows with a null owner count as the owner of their repository; a null repository is
none; repeated rows add no owner; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
MIXED = r"([A-Za-z0-9+/_-]{20,})"
KINDS = {"assign": (ASSIGN, 2), "access": (ACCESS, 1), "hex": (HEX, 1), "mixed": (MIXED, 1)}
BASE = ("assign", "access", "hex")
ASSIGN_CHARS = 12
#: From so many distinct owners on, or with two owners from so many distinct repositories on, a value is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 10
#: Candidates of one hash that are judged in one task, and hashes that can have more: with n candidates in
#: all a hash counts as hot from max(HOT_ROWS, n / HOT_HASHES) on, so there are never more.
HOT_ROWS, HOT_HASHES = 10_000, 100_000
#: A live value has at least so many different characters and none of these words (fixed values).
LIVE_CHARS = 8
PLACEHOLDERS = "example|sample|dummy|changeme|placeholder|your[_-]|xxxx|test[_-]|redacted"


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def _looks_live(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS) & ~F.lower(value).rlike(PLACEHOLDERS)


_COUNTED = {"assign": lambda v: F.length(v) >= ASSIGN_CHARS, "mixed": _mixed}


def _found(text: Column, kind: str) -> Column:
    """All matches of a kind in order: the characters before it since the last one, its own and its value's,
    and the value's hash and looks (null if the match does not count)."""
    pattern, group = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group > 1 else whole

    def row(x: Column, i: Column) -> Column:
        counted = _COUNTED.get(kind, lambda v: F.lit(True))(x["value"])
        of = {"value_hash": F.sha2(x["value"], 256), "live": _looks_live(x["value"])}
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("length"), F.length(x["value"]).alias("width"), *(F.when(counted, v).alias(k) for k, v in of.items()))

    # what follows the last match is a gap without a match
    rows = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value")), lambda x: x["whole"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(rows, row)).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,length:int,width:int,value_hash:string,live:boolean>>"))


def _joined(spans: Column) -> Column:
    """Spans (s, rank, e, kind), sorted, as kind:start:end joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """owners and repositories (distinct ones) and copies of each value hash, from rows (value_hash, owner, repository).

    Rows become distinct by owner and by repository on the map side, so a value that a third of all rows
    hold is spread over its holders before it is counted.
    """
    return candidates.groupBy("value_hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.count("*").alias("copies"))


def judged(places: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``places`` (_row, value_hash and others) with the owners and repositories of their hash."""
    total = verdicts.agg(F.sum("copies")).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_HASHES)
    hot = F.broadcast(verdicts.where(F.col("copies") > most).select("value_hash", F.ceil(F.col("copies") / most).alias("parts")))  # at most HOT_HASHES rows
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = places.join(hot, "value_hash", "left").withColumn("part", F.pmod(F.xxhash64("_row", "i"), parts)).drop("parts")
    copies = verdicts.join(hot, "value_hash", "left").select("value_hash", "owners", "repositories", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return dealt.join(copies, ["value_hash", "part"])


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """A row for each document: the base counts and digest, all spans, n_live and n_copied values, n_owners and n_repositories.

    docs needs doc_id, text and the two columns named.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    repo = F.col(repository).cast("string")
    held = docs.select("doc_id", text.alias("text"), F.coalesce(F.concat(F.lit("o:"), F.col(owner)), F.concat(F.lit("r:"), repo), F.lit("?")).alias("owner"), repo.alias("repository"))
    found = held.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "owner", "repository", F.concat(*(_found(F.col("text"), k) for k in KINDS)).alias("matches"))
    found = common.written(found, "secrets", None)

    matches = found.where(F.size("matches") > 0).select("_row", "owner", "repository", F.inline("matches"))
    verdicts = common.written(ownership(matches.where("value_hash is not null")), "owners")
    upto = W.partitionBy("_row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    places = matches.withColumn("e", F.sum(F.col("gap") + F.col("length")).over(upto)).where("value_hash is not null")
    places = judged(places.select("_row", "i", "kind", "width", "live", "value_hash", (F.col("e") - F.col("length")).alias("s"), "e"), verdicts)

    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("owners") > 1) & (F.col("repositories") >= COPIED_REPOSITORIES)
    rank = F.array_position(F.array(*map(F.lit, BASE)), F.col("kind"))
    base = F.when(rank > 0, F.struct("s", rank.alias("rank"), "e", "kind"))
    # An assigned value starts later than its span, and one value can be found by several kinds: live
    # spans are the values' own places, each once.
    live = F.when(F.col("live") & ~copied, F.struct((F.col("e") - F.col("width")).alias("s"), F.lit(len(BASE) + 1).cast("long").alias("rank"), "e", F.lit("live").alias("kind")))
    per_row = places.groupBy("_row").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE),
        F.collect_list(base).alias("base"),
        F.collect_set(live).alias("live"),
        F.count_distinct(F.when(copied, F.col("value_hash"))).alias("n_copied"),
        F.max("owners").alias("n_owners"),
        F.max("repositories").alias("n_repositories"),
    )
    none = F.array().cast("array<struct<s:long,rank:long,e:long,kind:string>>")
    base, live = F.coalesce("base", none), F.coalesce("live", none)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("_row", "doc_id").join(per_row, "_row", "left").select(
        "doc_id",
        *(number(f"n_{k}") for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, live)).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        *(number(c) for c in ("n_copied", "n_owners", "n_repositories")),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(common.documents(spark, sf_dir))


def _sql_found(kind: str, pattern: str, group: int) -> str:
    return f"""
  SELECT doc_id, source, '{kind}' AS kind, i, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i-1], '')) AS s,
    length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i], '')) AS e, v[i] AS value
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, source, string_split_regex(text, $p${pattern}$p$) AS g, regexp_extract_all(text, $p${pattern}$p$, 0) AS m,
      regexp_extract_all(text, $p${pattern}$p$, {group}) AS v FROM d))"""


_SQL_ASSIGN = "({})".format("|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in x) for x in ("password", "passwd", "secret", "token"))).replace(")", "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])") + ASSIGN.split("))", 1)[1]

ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), f AS ({_sql_found("assign", _SQL_ASSIGN, 2)}
  UNION ALL {_sql_found("access", ACCESS, 1)}
  UNION ALL {_sql_found("hex", HEX, 1)}
  UNION ALL {_sql_found("mixed", MIXED, 1)}
), c AS (
  SELECT * FROM f WHERE CASE kind WHEN 'assign' THEN length(value) >= {ASSIGN_CHARS}
    WHEN 'mixed' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') ELSE true END
), o AS (
  SELECT value, owners, repositories, owners >= {COPIED_OWNERS} OR owners > 1 AND repositories >= {COPIED_REPOSITORIES} AS copied FROM (
    SELECT value, count(DISTINCT coalesce('o:' || source, 'r:' || doc_id, '?')) AS owners, count(DISTINCT doc_id) AS repositories FROM c GROUP BY value)
), j AS (
  SELECT c.*, owners, repositories, copied, NOT copied AND len(list_distinct(string_split(value, ''))) >= {LIVE_CHARS} AND NOT regexp_matches(lower(value), '{PLACEHOLDERS}') AS live
  FROM c JOIN o USING (value)
), spans AS (
  SELECT doc_id, kind, s, e, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS rank FROM c WHERE kind <> 'mixed'
  UNION ALL SELECT DISTINCT doc_id, 'live', e - length(value), e, 3 FROM j WHERE live
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    count(*) FILTER (kind = 'live') AS n_live,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM spans GROUP BY doc_id
), cp AS (SELECT doc_id, count(DISTINCT value) FILTER (copied) AS n_copied, max(owners) AS n_owners, max(repositories) AS n_repositories FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied,
  coalesce(n_owners, 0)::BIGINT AS n_owners, coalesce(n_repositories, 0)::BIGINT AS n_repositories
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN cp USING (doc_id)
"""
