"""Every registered query against its SQL, over whole tables."""

import pytest

from graphloom.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES
from tests.conftest import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_entry_imports_and_registers():
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_reaches_the_scan(spark):
    plan = QUERIES["subtree_scan"](spark, SF)._jdf.queryExecution().toString()
    assert "StringStartsWith(url,https://blog.tionsh" in plan
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_stream_in_several_batches(spark, tmp_path):
    from graphloom.streaming.upsert import upserted

    df = spark.read.parquet(f"{SF}/events.parquet")
    df.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    got = upserted(spark, f"file://{tmp_path}/events.parquet", "user_id", ["ts", "event_id"], ["event_type"])
    want = QUERIES["latest_per_path"](spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_stream_goes_on(spark, tmp_path):
    from graphloom.streaming.upsert import upserted

    df = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "events.parquet.bak").write_text("not part of the table")
    df.where("event_id % 2 = 0").write.parquet(str(tmp_path / "events.parquet"))
    run = lambda: upserted(spark, f"file://{tmp_path}/events.parquet", "user_id", ["ts", "event_id"], ["event_type"], base=f"file://{tmp_path}/base")
    run()
    df.where("event_id % 2 = 1").write.mode("append").parquet(str(tmp_path / "events.parquet"))
    run()
    got, want = run(), QUERIES["latest_per_path"](spark, SF)  # the last call finds nothing new
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
