"""Core queries against their SQL on rows that only larger tables hold."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark import queries
from tidemark.operators import matrix
from tidemark.plans import models


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query and of its SQL over the given tables, sorted."""

    def run(name: str, **tables: pa.Table):
        con = duckdb.connect()
        for t, rows in tables.items():
            pq.write_table(rows, tmp_path / f"{t}.parquet")
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        want = con.execute(queries.ORACLES[name])
        columns = [c[0] for c in want.description]
        key = lambda r: tuple((v is None, v) for v in r)
        return sorted((tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)

    return run


def test_points_on_edges(against_sql):
    # x - 5000 = 8.5 (k mod 997) is the polygon's slanted edge; 0 and 997 are on the lower one; a null place is in none
    at = {10: 5085.0, 20: 5170.0, 997: 12.5, 0: 5000.0, 300: None, 400: 100.0, 401: 5000.0}
    got, want = against_sql("points_in_polygon", customer=pa.table({"c_custkey": list(at), "c_acctbal": pa.array(at.values(), pa.float64())}))
    assert got == want and {k: i for k, i, _ in got} == {10: False, 20: False, 997: True, 0: False, 300: False, 400: False, 401: True}


def test_convergence_over_missing_values(against_sql):
    # six users of 40 events; nulls in some series, among them whole frames, and one NaN
    rng = np.random.default_rng(4)
    value = [None if u in (1, 2) and i % (7 - 4 * (u == 2)) == 0 or u == 3 and i < 25 else float("nan") if (u, i) == (4, 12) else float(x) for u in range(6) for i, x in enumerate(np.round(rng.normal(50, 9, 40), 2))]
    table = pa.table({"event_id": range(240), "user_id": [n // 40 for n in range(240)], "ts": pa.array(range(240), pa.timestamp("us")), "event_type": ["view"] * 240, "value": pa.array(value, pa.float64())})
    got, want = against_sql("convergence_point", events=table)
    assert got == want and dict(got)[1] is not None


def clusters(rows, eps, least):
    """DBSCAN of (key, x, y) point by point; the rows of a repeated key are one node."""
    rows = [r for r in rows if None not in r[1:] and np.isfinite(r[1:]).all()]
    p, keys = np.array([r[1:] for r in rows]), [r[0] for r in rows]
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) <= eps
    pairs = [(keys[i], keys[j]) for i, j in zip(*np.nonzero(near), strict=True)]
    n = {}
    for a, _ in pairs:
        n[a] = n.get(a, 0) + 1
    core = {k for k, c in n.items() if k is not None and c >= least}
    label, links = {k: k for k in core}, [(a, b) for a, b in pairs if a in core and b in core]
    while True:
        was = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if was == label:
            break
    edge = {}
    for a, b in pairs:
        if b in core and a not in core and a is not None:
            edge[a] = min(edge.get(a, label[b]), label[b])
    return edge | label


def test_dbscan_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(11)
    turn = np.linspace(0, np.pi / 2, 90)
    ring = lambda r: np.column_stack([r * np.cos(turn), r * np.sin(turn)]) - 9
    pts = np.concatenate([rng.uniform(0, 6, (130, 2)), ring(3.0), ring(3.52), ring(4.01), rng.uniform(0, 0.3, (20, 2)) + 8, rng.uniform(0, 0.3, (20, 2)) + [8.78, 8], np.repeat([[-3.0, 4.0]], 30, axis=0)])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(pts)]
    rows += [(None, 8.1, 8.1), (None, 20.0, 20.0), *((900 + i, 20.0, 20.0) for i in range(3)), (7, -3.0, 4.2), (8, 30.0, 30.0), (8, 30.1, 30.0), (910, 30.2, 30.0), (911, None, 8.0), (912, float("nan"), 8.0), (913, float("inf"), 8.0)]
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = [tuple(r) for r in models.dbscan(spark.createDataFrame(rows, "i long, x double, y double"), "i", "x", "y", 0.5, 4).collect()]
    want = clusters(rows, 0.5, 4)
    assert sorted(got, key=str) == sorted(((k, want.get(k, -1)) for k, *_ in rows), key=str)
    assert len(set(want.values())) > 5


def test_dbscan_writes_no_pairs(spark, tmp_path):
    pts = np.random.default_rng(12).normal(0, 0.2, (1500, 2))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "i long, x double, y double")
    assert {r["cluster"] for r in models.dbscan(df, "i", "x", "y", 0.5, 4).collect()} == {0}
    assert sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(tmp_path) for f in files) < 1500 * 1000


def test_sets_within(monkeypatch):
    monkeypatch.setattr(models, "PAIRS", 6)
    rng = np.random.default_rng(13)
    for case in range(200):
        a, b = rng.uniform(0, 1, (rng.integers(0, 40), 2)), rng.uniform(0, 1, (rng.integers(0, 40), 2)) + [1.3, 0.2 * (case % 3)]
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        for eps in (0.1, 0.4, *([d.min(), np.nextafter(d.min(), 0)] if d.size else [])):
            assert models.within(a, b, eps) == bool((d <= eps).any())


def test_block_products_move_vectors_once(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    pairs = matrix.cosines(df, "vec_id", "embedding", 4)
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "explode" not in plan
    assert pairs.count() == 40 * 39 // 2 == pairs.select("a", "b").distinct().count()
