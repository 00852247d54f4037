"""The pipeline against brute force on a small fixture, stage by stage and as a whole."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphloom.llm import packing
from tests.llm.conftest import SCHEMA, SF
from tests.llm.test_operators import brute_components, words_of


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(900, "12 34 56", "en", "src1", 8), (901, None, "en", "src1", None), (902, "", None, None, 0)], SCHEMA))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [df.toPandas() for df in out]


def test_columns(stages):
    assert all(list(df.columns) == list(stages[0].columns) for df in stages[:-1])


def test_language_stage_drops_only_what_has_no_language(stages):
    before, after = stages[:2]
    assert set(before.doc_id) - set(after.doc_id) == {900, 901, 902}


def test_line_stage(stages):
    before, after = (df.set_index("doc_id") for df in stages[1:3])
    first, gone = {}, collections.defaultdict(set)
    for d in sorted(before.index):
        lines = [x for x in (line.strip(" \t\r\x0b\x0c") for line in before.text[d].split("\n")) if x]
        for i in range(len(lines) - 2):
            if first.setdefault(tuple(lines[i : i + 3]), (d, i)) != (d, i):
                gone[d] |= {i, i + 1, i + 2}
    for d in before.index:
        i, kept = -1, []
        for line in before.text[d].split("\n"):
            i += bool(line.strip(" \t\r\x0b\x0c"))
            if not (line.strip(" \t\r\x0b\x0c") and i in gone[d]):
                kept.append(line)
        if gone[d] and not words_of("\n".join(kept)):
            assert d not in after.index
        else:
            assert after.text[d] == "\n".join(kept) and after.n_chars[d] == len(after.text[d])


def test_near_stage(stages):
    before, after = stages[2:4]
    roots = brute_components(list(zip(before.doc_id.astype(int), before.text)), 5)
    assert set(after.doc_id) == {d for d, (_, root) in roots.items() if d == root}


def test_mixing_stage(stages):
    before, after = stages[3:5]
    times = after.doc_id.value_counts()
    size = {d: len(words_of(t)) for d, t in zip(before.doc_id, before.text)}
    assert set(times.index) <= set(before.doc_id) and times.max() <= 3
    total = sum(size.values())
    taken = sum(size[d] * n for d, n in times.items())
    assert abs(taken - total) < 0.05 * total


def test_packing_stage(spark, stages):
    before, after = stages[4:]
    encode = packing.encoder(packing.default_tokenizer())
    assert after.length.sum() == sum(len(encode(t or "")) + 1 for t in before.text)
    assert after.groupby("sequence_id").length.sum().max() <= 2048


def test_run_is_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") < 40)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    want = docs.toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[key].values.tolist()) == sorted(want[key].values.tolist())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_near_stage_judges_every_row(spark):
    prose, other = (" ".join(f"{w}{i}" for i in range(60)) for w in "xy")
    near = other.replace("y59", "z")
    rows = [(None, prose), (7, prose), (None, prose), (7, prose), (None, other), (None, other), (None, near), (None, "stands alone without an id"), (8, "also alone"), (None, ""), (None, None)]
    out = corpus_pipeline.dedup_near(spark, spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA), SF).collect()
    assert [r.doc_id for r in out if r.text == prose] == [7] and sum(r.text in (other, near) for r in out) == 1
    assert sorted(r.text for r in out if r.text is not None and r.text not in (prose, other, near)) == ["", "also alone", "stands alone without an id"]
    assert len(out) == 6
