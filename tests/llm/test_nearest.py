"""Nearest neighbours against brute force: whole on small tables, with a recall of 0.9 where the forest descends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import annforest


def table(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def rows(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def brute(x, i, k=10):
    far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    order = np.lexsort((np.arange(len(x)), far))
    return [(int(j), float(far[j])) for j in order if j != i][:k]


@pytest.mark.parametrize("n, array", [(2, 4096), (6, 4096), (12, 4096), (30, 7)])
def test_small_tables_are_searched_whole(spark, monkeypatch, n, array):
    monkeypatch.setattr(annforest, "ARRAY", array)
    x = np.random.default_rng(n).normal(size=(n, 64))
    got = rows(annforest.nearest(table(spark, x), F.lit(True)))
    for i in range(n):
        want = brute(x, i)
        assert [a for a, _ in got[i]] == [a for a, _ in want] and np.allclose([s for _, s in got[i]], [s for _, s in want], rtol=0, atol=0)


@pytest.mark.parametrize("n, every, array", [(500, 10, 4096), (10_000, 100, 512)])
def test_recall_where_the_forest_descends(spark, monkeypatch, n, every, array):
    monkeypatch.setattr(annforest, "ARRAY", array)
    x = np.random.default_rng(1).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    whole = []
    monkeypatch.setattr(annforest, "_searched_whole", lambda *a, f=annforest._searched_whole: whole.append(1) or f(*a))
    got = rows(annforest.nearest(df, F.col("vec_id") % every == 0))
    assert sorted(got) == list(range(0, n, every)) and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({a for a, _ in got[i]} & {a for a, _ in brute(x, i)}) / 10 for i in got])
    assert recall >= 0.9 and not whole
    assert all(abs(s - np.sqrt(((x[a] - x[i]) ** 2).sum())) == 0 for i, v in got.items() for a, s in v)


def test_lengths_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(annforest, "FORESTS", 1)
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, [3.0]), (6, [1.0, 1.0, 1.0]), (7, [0.0]), (8, None), (None, [1.0, 0.0])]
    got = rows(annforest.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.lit(True)))
    assert got[0] == [(1, 0.0), (2, 0.0), (3, 2**0.5)] and got[2][:2] == [(0, 0.0), (1, 0.0)]
    assert got[4] == [(5, 2.0)] and got[5] == [(4, 2.0)] and not {6, 7, 8} & set(got)
