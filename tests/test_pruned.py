"""Pruned nearest neighbours: the same rows as all pairs give, from a part of them."""

import numpy as np
import pytest

from graphloom.operators import pruned, search


def frame(spark, matrix, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(matrix)), matrix)], "id long, vector array<float>")


def rows_of(df):
    return sorted((r.query_id, r.nth, r.id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5])
def test_clustered_vectors(spark, k):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16)) * 10
    matrix = centers[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    matrix[500:520] = matrix[500]  # ties go by id
    rows = frame(spark, matrix)
    queries = rows.where("id % 20 = 0")
    got, share = pruned.knn_pruned(queries, rows, k)
    assert rows_of(got) == rows_of(search.knn_join(queries, rows, k)) and 0 < share < 0.3


def test_vectors_without_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(pruned, "ROWS", 50)  # several blocks a cell
    rows = frame(spark, np.concatenate([rng.normal(size=(300, 8)), np.ones((200, 8))]))
    queries = rows.where("id % 20 = 0").unionByName(frame(spark, rng.normal(size=(5, 8)) * 50, ids=range(1000, 1005)))
    got, share = pruned.knn_pruned(queries, rows, 3)
    assert rows_of(got) == rows_of(search.knn_join(queries, rows, 3)) and share <= 1.5


def test_few_rows(spark):
    rows = frame(spark, [[0, 0], [1, 0], [0, 2]])
    got, _ = pruned.knn_pruned(rows, rows, 5)
    assert rows_of(got) == rows_of(search.knn_join(rows, rows, 5)) and got.count() == 6
    assert pruned.knn_pruned(rows.limit(0), rows)[0].count() == 0 and pruned.knn_pruned(rows, rows.limit(0))[0].count() == 0
