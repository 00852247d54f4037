"""Descriptions by class, and clients that hang."""

import json
import time

import pandas as pd
from pyspark.sql import functions as F

from graphloom.operators import describe, extract

SOURCE = b"""class A:
    class B:
        def f(self):
            pass

    def g(self):
        pass

    def h(self):
        pass

    def known(self):
        pass


def free(a):
    return a


class Empty:
    pass
"""


def nodes(spark, text=SOURCE):
    got = extract.extract(spark.createDataFrame([("a.py", bytearray(text), "python")], "path string, content binary, lang string"))
    return got.withColumn("description", F.when(F.col("name") == "known", "already").otherwise(""))


def client(calls, answer):
    def run(prompts):
        for part in prompts:
            calls.add([json.loads(p) for p in part])
            yield pd.Series([answer(json.loads(p)) for p in part])

    run.by_class = True
    return run


def collector(spark):
    from pyspark import AccumulatorParam

    class Lists(AccumulatorParam):
        def zero(self, value):
            return []

        def addInPlace(self, a, b):  # noqa: N802 - the name is Spark's
            return a + b

    return spark.sparkContext.accumulator([], Lists())


def test_one_call_a_class(spark):
    calls, lock = collector(spark), spark.createDataFrame([], "uid string, diff_hash string, description string")

    def answer(prompt):
        told = {k: f"does {v.split('(')[0]}" for k, v in prompt["methods"].items() if "def h" not in v}
        return json.dumps({"description": f"of {prompt['code'].splitlines()[0]}", "description_map": told | {"77": "nobody asked", "x": "no number"}})

    got = {r.uid: r.description for r in describe.described(nodes(spark), lock, client(calls, answer)).collect()}
    assert got["a.py#A.g(...)"] == "does def g" and got["a.py#A.h(...)"] == "" and got["a.py#A.known(...)"] == "already"
    assert got["a.py#A.B.f(...)"] == "does def f" and got["a.py#free(...)"] == "does def free"
    assert got["a.py#A"] == "of class A" and got["a.py#A.B"] == "of class B" and got["a.py#Empty"] == "of class Empty" and got["a.py"].startswith("of a.py: ")
    asked = sorted(calls.value, key=lambda p: p["code"].splitlines()[0])
    assert len(asked) == 4 and sorted(len(p["methods"]) for p in asked) == [0, 1, 1, 2]
    outer = next(p for p in asked if p["code"].startswith("class A\n"))
    assert set(outer["methods"]) == {"0", "1"} and "// of class B" in outer["code"] and "// already" in outer["code"]


def test_large_classes_in_parts_and_bad_answers(spark):
    text = b"class Big:\n" + b"".join(b"    def m%02d(self):\n        return %d\n\n" % (i, i) for i in range(30)) + b"\n\nclass Bad:\n    def q(self):\n        pass\n"
    calls, lock = collector(spark), spark.createDataFrame([], "uid string, diff_hash string, description string")

    def answer(prompt):
        if "Bad" in prompt["code"].splitlines()[0]:
            return "not JSON {"
        return json.dumps({"description": str(sorted(map(int, prompt["methods"]))), "description_map": {k: k for k in prompt["methods"]}})

    rows = nodes(spark, text)
    got = {r.name: r.description for r in describe.described_by_class(rows, lock, client(calls, answer), chars=300).collect()}
    assert [got[f"m{i:02d}"] for i in range(30)] == [str(i) for i in range(30)] and got["q"] == "" and got["Bad"] == ""
    sizes = [sum(map(len, p["methods"].values())) for p in calls.value if p["methods"] and "Big" in p["code"].splitlines()[0]]
    assert len(sizes) > 3 and max(sizes) < 400 and got["Big"].startswith("[0, 1")


def test_hanging_calls_are_given_up():
    tries = []

    def call(text):
        tries.append(text)
        if text == "hang" or tries.count(text) < 2:
            time.sleep(30)
        return text.upper()

    began = time.perf_counter()
    run = describe.retrying(call, attempts=2, backoff=0.01, timeout=0.2)
    assert [x.tolist() for x in run(iter([pd.Series(["a", "hang"])]))] == [["A", None]]
    assert time.perf_counter() - began < 10 and tries.count("hang") == 2
