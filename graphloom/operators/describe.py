"""Texts for embedding, descriptions, and a vectoriser that needs no model."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scratch import written
from graphloom.operators.graph import ancestors
from graphloom.operators.reconcile import seed

DIMENSION = 384


def _filled(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def embedding_text() -> Column:
    """``uid: `` and the description, else the body, the signature or the name."""
    return F.concat(F.col("uid"), F.lit(": "), F.coalesce(_filled("description"), _filled("body"), _filled("signature"), F.col("name")))


def eligible(structs: DataFrame) -> DataFrame:
    """Fields and directories are not embedded."""
    return structs.where("type not in ('field', 'directory')")


def skeleton_text(classes: DataFrame, children: DataFrame) -> DataFrame:
    """(id, text): each class's signature and its described children, as input to a description."""
    child = F.concat(F.col("id"), F.lit(" | "), F.coalesce("signature", "uid"), F.lit("\n// "), F.col("description"))
    listed = children.where("description <> ''").groupBy(F.col("parent_uid").alias("uid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", child.alias("t")))), lambda x: x["t"]), "\n").alias("children"))
    return classes.join(listed, "uid", "left").select("id", F.concat_ws("\n", "signature", "children").alias("text"))


def _filled_in(rows: DataFrame, children: DataFrame) -> DataFrame:
    """``rows`` with what needs no client: empty files are called so, a file whose only child is a class or field takes its description."""
    child = children.groupBy(F.col("parent_uid").alias("uid")).agg(F.count("*").alias("_n"), F.min(F.struct("type", "description")).alias("_only"))
    empty = (F.col("type") == "file") & F.col("_n").isNull() & (F.trim(F.coalesce("body", F.lit(""))) == "")
    single = (F.col("type") == "file") & (F.col("_n") == 1) & (F.col("_only.type") != "method")
    text = F.when(empty, F.lit("Empty File")).when(single, F.nullif(F.col("_only.description"), F.lit("")))
    return rows.join(child, "uid", "left").withColumn("description", F.coalesce(_filled("description"), text, F.lit(""))).select(*rows.columns)


def described(structs: DataFrame, lock: DataFrame, client: Callable[[Iterator[pd.Series]], Iterator[pd.Series]] | None = None) -> DataFrame:
    """``structs`` with descriptions: their own, else the lockfile's of the same content, else the client's.

    The client is a pandas iterator function from text to description, in batches where the rows lie; there
    is none unless one is given. It is asked level by level, children before parents, each level a written
    table; a class is described from its signature and its described children. A client with ``by_class`` set is asked by
    ``described_by_class``.
    """
    rows = seed(structs, lock)
    if client is None:
        return _filled_in(rows, rows)
    if getattr(client, "by_class", False):
        return described_by_class(structs, lock, client)

    def asked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from client(texts)

    depth = ancestors(structs.select(F.col("uid").alias("id"), F.col("parent_uid").alias("parent_id"))).groupBy(F.col("id").alias("uid")).agg(F.max("depth").alias("_depth"))
    rows = written(rows.join(depth, "uid").select(*structs.columns, "_depth"), "levels")
    deepest = rows.agg(F.max("_depth")).first()[0]
    out = below = rows.limit(0)
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = _filled_in(rows.where(F.col("_depth") == level), below)
        texts = skeleton_text(here.where("type = 'class'"), below).withColumnRenamed("text", "_class")
        ask = F.pandas_udf(asked, "string")(F.coalesce(F.nullif("_class", F.lit("")), embedding_text()))
        open_ = here.where("description = '' and type in ('file', 'class', 'method')").join(texts, "id", "left")
        open_ = open_.withColumn("description", F.coalesce(ask, F.lit(""))).select(*rows.columns)
        below = written(open_.unionByName(here.where("description <> '' or type not in ('file', 'class', 'method')")), "described")
        out = out.unionByName(below)
    return out.select(*structs.columns)


#: Characters of methods in one prompt, about; larger classes are asked in several.
PROMPT_CHARS = 24_000
_ANSWER = "description string, description_map map<string,string>"


def prompts(owners: DataFrame, methods: DataFrame, below: DataFrame, chars: int = PROMPT_CHARS) -> tuple[DataFrame, DataFrame]:
    """What a client of classes is asked: (uid, part, prompt) for each of ``owners`` (classes and files), and
    (uid, part, index, method_uid) of the methods that stand in the prompts.

    A prompt is JSON: ``code``, the owner's signature and described children (a file's text), and ``methods`` by index, with
    signature and body. Methods stand in order of lines; a part holds ``chars`` characters of them, or one.
    """
    open_ = methods.where(_filled("description").isNull()).join(owners.select(F.col("uid").alias("parent_uid")), "parent_uid", "left_semi")
    text = F.concat_ws("\n", "signature", "body")
    upto = W.partitionBy("parent_uid").orderBy("start_line", "uid")
    listed = open_.select(F.col("parent_uid"), F.col("uid").alias("method_uid"), text.alias("text"), (F.row_number().over(upto) - 1).alias("index"), (F.sum(F.length(text)).over(upto) - F.length(text)).alias("before"))
    listed = listed.select(F.col("parent_uid").alias("uid"), F.floor(F.col("before") / chars).cast("int").alias("part"), "index", "method_uid", "text")
    asked = listed.groupBy("uid", "part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("index").cast("string").alias("key"), "text")))).alias("methods"))
    codes = skeleton_text(owners.where("type = 'class'"), below).withColumnRenamed("text", "_class")
    own = owners.join(codes, "id", "left").select("uid", F.coalesce(F.nullif("_class", F.lit("")), embedding_text()).alias("code"))
    parts = own.join(asked, "uid", "left").select("uid", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(F.struct("code", F.coalesce("methods", F.create_map().cast("map<string,string>")).alias("methods"))).alias("prompt"))
    return parts, listed.drop("text")


def described_by_class(structs: DataFrame, lock: DataFrame, client: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], chars: int = PROMPT_CHARS) -> DataFrame:
    """As ``described`` with one call for a class (or file) and all its methods that have no description.

    The client is a pandas iterator function from prompts (see ``prompts``) to answers, JSON with
    ``description`` and ``description_map`` from index to text. Answers that are no JSON, and indexes that are missing
    or that nobody asked for, change nothing; of an owner in several parts the first one's description stands. Inner
    classes come first, each level from a written table; owners that have a description are not asked.
    """

    def asked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from client(texts)

    depth = ancestors(structs.select(F.col("uid").alias("id"), F.col("parent_uid").alias("parent_id"))).groupBy(F.col("id").alias("uid")).agg(F.max("depth").alias("_depth"))
    rows = written(seed(structs, lock).join(depth, "uid").select(*structs.columns, "_depth"), "levels")
    methods, owners = rows.where("type = 'method'"), rows.where("type <> 'method'")
    deepest = owners.agg(F.max("_depth")).first()[0]
    out = below = owners.limit(0)
    told = methods.select(F.col("uid").alias("method_uid"), F.lit("").alias("_told")).limit(0)
    for level in range(-1 if deepest is None else deepest, -1, -1):
        children = below.unionByName(methods.where(F.col("_depth") == level + 1))
        here = _filled_in(owners.where(F.col("_depth") == level), children)
        open_ = written(here.where("description = '' and type in ('file', 'class')"), "open")
        parts, listed = prompts(open_, methods, children, chars)
        answer = F.from_json(F.pandas_udf(asked, "string")("prompt"), _ANSWER)
        answers = written(parts.select("uid", "part", answer.alias("a")), "answers")
        pairs = answers.select("uid", "part", F.explode("a.description_map").alias("key", "_told")).withColumn("index", F.col("key").try_cast("int")).drop("key")
        told = told.unionByName(written(listed.join(pairs, ["uid", "part", "index"]).select("method_uid", "_told"), "told"))
        own = answers.where("part = 0").select("uid", F.col("a.description").alias("_own"))
        open_ = open_.join(own, "uid", "left").withColumn("description", F.coalesce("_own", F.lit(""))).select(*rows.columns)
        below = written(open_.unionByName(here.where("description <> '' or type not in ('file', 'class')")), "described")
        out = out.unionByName(below)
    told = told.groupBy(F.col("method_uid").alias("uid")).agg(F.min("_told").alias("_told"))
    methods = methods.join(told, "uid", "left").withColumn("description", F.coalesce(_filled("description"), "_told", F.lit("")))
    return out.unionByName(methods.select(*rows.columns)).select(*structs.columns)


#: Clients by name, for settings and commands: add yours before a project is made. Class clients have ``by_class`` set.
CLIENTS: dict[str, Callable] = {}


class ClientError(Exception):
    """Settings name a client that is not there."""


def retrying(call: Callable[[str], str], attempts: int = 3, backoff: float = 2.0, at_once: int = 10, timeout: float = 10.0, again: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """A client for ``described`` from a function of one text.

    A worker has ``at_once`` calls under way at most. A call that takes longer than ``timeout`` seconds is given up as a
    TimeoutError; its thread is left behind and ends with the worker. Errors in ``again`` are tried again after backoff,
    2 * backoff, ... seconds; a text whose attempts are used up, or that fails otherwise, stays without a description.
    """

    def timed(text: str) -> str:
        done: list = []

        def run() -> None:
            try:
                done.append((call(text), None))
            except Exception as e:  # noqa: BLE001 - raised again where it is waited for
                done.append((None, e))

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        thread.join(timeout)
        if not done:
            raise TimeoutError
        if done[0][1] is not None:
            raise done[0][1]
        return done[0][0]

    def one(text: str) -> str | None:
        for k in range(attempts):
            try:
                return timed(text)
            except again:
                if k + 1 < attempts:
                    time.sleep(backoff * 2**k)
            except Exception:  # noqa: BLE001 - a text that cannot be described costs itself only
                break
        return None

    def client(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(at_once) as pool:
            for part in texts:
                yield pd.Series(list(pool.map(one, part)), dtype=object)

    return client


def client_for(settings: dict, clients: dict[str, Callable], override: str | None = None) -> Callable | None:
    """The client that ``override`` or else the settings' ``[llm] strategy`` names; none for ``none`` or without either."""
    name = override or settings.get("llm", {}).get("strategy") or "none"
    if name != "none" and name not in clients:
        raise ClientError(f"no description client is called {name}; known: {', '.join(sorted(clients)) or 'none'}")
    return clients.get(name)


def pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors that the mask keeps, scaled to length 1."""
    weight = mask[..., None].astype(np.float64)
    mean = (tokens * weight).sum(axis=1) / np.clip(weight.sum(axis=1), 1e-9, None)
    return mean / np.clip(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9, None)


def hashed_vectors(rows: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(id, vector) of rows (id, text): signed counts of hashed words, scaled to length 1; expressions only."""
    words = rows.select("id", F.explode(F.split(F.lower("text"), "[^0-9a-z]+")).alias("w")).where("w <> ''")
    h = F.xxhash64("w")
    counts = words.groupBy("id", F.pmod(h, F.lit(dimension)).cast("int").alias("i")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 40), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("x"))
    values = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.greatest("norm", F.lit(1e-9))).cast("float"))
    return values.select("id", value.alias("vector"))


def model_vectors(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int = DIMENSION, batch: int = 32) -> DataFrame:
    """(id, vector) of rows (id, text) by a model that ``load`` brings up once a worker; a batch that fails gives nulls.

    The model gives a vector for each text, or token vectors and their mask, which are pooled.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in texts:
            out: list = []
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch].tolist()
                try:
                    made = model(some)
                    out += [v.astype(np.float32).tolist() for v in (pooled(*made) if isinstance(made, tuple) else made)]
                except Exception:  # noqa: BLE001 - whatever a model raises costs its batch only
                    out += [None] * len(some)
            yield pd.Series(out)

    return rows.select("id", F.pandas_udf(run, "array<float>")("text").alias("vector"))
