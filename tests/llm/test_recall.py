"""Vector search finds the nearest rows in wide tables, and k rows whenever there are k."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import vector_search


def search(spark, x):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    held: dict = {}
    for r in vector_search.nearest(rows, F.col("id") % 50 == 0).collect():
        held.setdefault(r.query_id, []).append((r["rank"], r.id))
    return {q: [i for _, i in sorted(found)] for q, found in held.items()}


def exact(x, q, k=5):
    unit = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit[q]
    score[q] = -np.inf
    return np.argsort(-score, kind="stable")[:k].tolist()


@pytest.mark.parametrize("dim", [64, 256, 768])
def test_recall_by_dimension(spark, dim):
    x = np.random.default_rng(dim).normal(size=(2000, dim)).astype(np.float32)
    got = search(spark, x)
    assert sorted(got) == list(range(0, 2000, 50)) and all(len(g) == 5 for g in got.values())
    assert np.mean([len(set(g) & set(exact(x, q))) / 5 for q, g in got.items()]) >= 0.98


def test_all_rows_of_a_small_table(spark):
    x = np.random.default_rng(1).normal(size=(6, 64)).astype(np.float32)
    assert search(spark, x) == {0: exact(x, 0)}


def test_query_away_from_a_cone(spark):
    rng = np.random.default_rng(2)
    axis = rng.normal(size=64)
    x = (axis + 0.02 * rng.normal(size=(400, 64))).astype(np.float32)
    x[0], x[50] = -axis, rng.normal(size=64)
    got = search(spark, x)
    assert sorted(got) == list(range(0, 400, 50)) and all(len(g) == 5 for g in got.values())
    assert got[0] == exact(x, 0) and got[50] == exact(x, 50)
