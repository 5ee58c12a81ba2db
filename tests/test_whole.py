"""Operators over all vectors against brute force on small tables that take several blocks."""

import numpy as np
import pytest


@pytest.fixture(scope="module")
def small(spark):
    """60 vectors of 3 labels, with a repeated vector, a zero one and ties."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 4)), 2)
    x[7], x[8], x[9] = x[6], x[6], 0
    rows = [(i * 3 - 20, [float(a) for a in x[i]], i % 3) for i in range(60)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_cluster_similarity_of_vectors(spark, small):
    from tidemark.operators import matrix as M

    rows, df = small
    got = {(r["a"], r["b"]): (r["mean"], r["high"], r["low"]) for r in M.cluster_similarity_of_vectors(df, "vec_id", "embedding", "label", 16).collect()}
    x, c = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    s = np.round(x @ x.T, 6)
    assert len(got) == 9
    for (a, b), g in got.items():
        part, own = s[np.ix_(c == a, c == b)], (np.eye(60, dtype=bool))[np.ix_(c == a, c == b)]
        assert np.allclose(g, (part[~own].mean(), part[~own].max(), part.min() if (part != 0).all() else 0.0), atol=1e-6)


def test_cosines(spark, small):
    from tidemark.operators import matrix as M

    rows, df = small
    got = {(r["a"], r["b"]): r["cosine"] for r in M.cosines(df, "vec_id", "embedding", 16).collect()}
    assert len(got) == 60 * 59 // 2
    for p, (a, x, _) in enumerate(rows):
        for b, y, _ in rows[p + 1 :]:
            n = np.linalg.norm(x) * np.linalg.norm(y)
            assert got[a, b] is None if n == 0 else abs(got[a, b] - np.dot(x, y) / n) < 1e-9


def test_nearest_by_dot(spark, small):
    from tidemark.operators import matrix as M

    rows, df = small
    got = {(r["i"], r["rank"]): r["j"] for r in M.nearest_by_dot(df, "vec_id", "embedding", 5, 16).collect()}
    assert len(got) == 300
    for a, x, _ in rows:
        want = sorted((round(-float(np.dot(x, y)), 9), b) for b, y, _ in rows if b != a)[:5]
        assert [got[a, k] for k in range(1, 6)] == [b for _, b in want]
