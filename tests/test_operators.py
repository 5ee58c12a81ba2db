"""Goldens and differential tests of the core operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import matrix as M
from tidemark.operators import series as S
from tidemark.operators import spectral
from tidemark.plans import models
from tidemark.sources import tables
from tidemark.spec import SeriesSpec
from tidemark.streaming import online

SPEC = SeriesSpec(("s",), ("t",))


def frame(spark, **series):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"s": k, "t": range(len(v)), "value": np.asarray(v, float)}) for k, v in series.items()]))


def test_runs(spark):
    cases = {"10110111": (5, 3), "1111": (0, 4), "1000": (0, 1), "0001": (3, 1), "0110111011": (4, 3), "0000": None}
    df = frame(spark, **{f"c{k}": [int(c) for c in k] for k in cases})
    got = {r["s"][1:]: (r["start"], r["length"]) for r in S.longest_run(df, SPEC, F.col("value") == 1).collect()}
    assert got == {k: v for k, v in cases.items() if v}
    ring = {"1001": (3, 2), "110111001": (3, 3), "1111": (0, 4), "1000": (0, 1), "0110111011": (4, 3)}
    df = frame(spark, **{f"c{k}": [int(c) for c in k] for k in ring})
    assert {r["s"][1:]: (r["start"], r["length"]) for r in S.longest_run(df, SPEC, F.col("value") == 1, circular=True).collect()} == ring


def test_convergence(spark):
    x = np.linspace(0, 2 * np.pi, 1000)
    traces = {"a": np.linspace(100, 0, 1000), "b": np.linspace(0, 100, 1000), "c": np.logspace(-3, 2, 1000), "d": np.logspace(2, -3, 1000), "e": 100 * np.cos(x), "f": 100 * np.sin(x)}
    df = frame(spark, **traces)
    for mode, tol, want in (("greater", -0.1, [None, 100, 100, 665, 550, 100]), ("abs_less", 0.1, [None, None, 100, 665, 550, 300]), ("less", 0.1, [100, None, 100, 100, 100, 300])):
        got = {r["s"]: r["converged_at"] for r in S.convergence(df, SPEC, 100, tol, mode).collect()}
        assert [got[k] for k in "abcdef"] == want, mode


def test_dates(spark):
    cases = {
        "/home/user/documents/20220203/report.txt": "20220203", "/home/user/docs/2022_02_03/report.pdf": "2022_02_03", "/home/02_03_22/data.txt": "02_03_22", "/2022-02-03/home/data.txt": "2022-02-03",
        "/home/data_2_3_2022.txt": "2_3_2022", "/home/docs/data_2-03-22.txt": "2-03-22", "C:\\home\\docs\\data_2-03-22.txt": "2-03-22", "/home/docs/19900101/data_2-03-22.txt": "2-03-22",
        "/home/docs/_1990010_/data_2023032.txt": None, "/home/docs/_1990010_/data_0 32.txt": None, "/home/docs/_/data_.txt": None, "/home/docs/_19900101_/data_20230322.txt": "20230322",
        "/a/2022.02/03 2x1.2.2022 and 3.4.2021": "3.4.2021",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want string")
    assert not df.where(~scalar.date_in_path(F.col("p")).eqNullSafe(F.col("want"))).collect()
    forward = ["/home/docs/19900101/data_2-03-22.txt", "/home/docs/_19900101/data_2-03-22.txt", "/home/docs/19900101_/data_2-03-22.txt", "/home/docs/_19900101_/data_2-03-22.txt",
               "/home/docs/_19900101_/data_020322.txt", "/home/docs/_19900101_/data_20230322.txt"]
    got = spark.createDataFrame([(p,) for p in forward], "p string").select(scalar.date_in_path(F.col("p"), last_part_first=False)).collect()
    assert {r[0] for r in got} == {"19900101"}


def test_cluster_similarity(spark):
    s = [[1, .5, .3, .1], [.5, 1, .1, .3], [.3, .1, 1, .5], [.1, .3, .5, 1]]
    labels = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, 1, 1])], "i int, c int")
    long = lambda m: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "i int, j int, v double")
    got = {(r["a"], r["b"]): (round(r["mean"], 6), r["high"], r["low"]) for r in M.cluster_similarity(long(s), labels).collect()}
    assert got == {(0, 0): (.5, .5, .5), (0, 1): (.2, .3, .1), (1, 0): (.2, .3, .1), (1, 1): (.5, .5, .5)}
    holes = [[1, 0, .3, 0], [0, 1, 0, 0], [.3, 0, 1, .5], [0, 0, .5, 1]]
    got = {(r["a"], r["b"]): (round(r["mean"], 6), r["high"], r["low"]) for r in M.cluster_similarity(long(holes), labels).collect()}
    assert got == {(0, 0): (0, 0, 0), (0, 1): (.075, .3, 0), (1, 0): (.075, .3, 0), (1, 1): (.5, .5, .5)}


@pytest.mark.parametrize("kernel", [[1.0, 2.0, 3.0, -1.0, 0.5], [1.0, -2.0, 0.5, 3.0]])
def test_convolution(spark, kernel):
    x = np.random.default_rng(0).normal(size=50)
    df = frame(spark, a=x)
    same = S.convolve(df, SPEC, kernel).orderBy("t").toPandas()["conv"]
    assert np.allclose(same, np.convolve(x, kernel, "same"))
    assert np.allclose(S.convolve(df, SPEC, kernel, "valid").orderBy("t").toPandas()["conv"], np.convolve(x, kernel, "valid"))


def test_rolling_percentile_against_pandas(spark):
    x = np.random.default_rng(1).normal(size=60)
    for w in (21, 20, 5, 4):
        got = S.rolling_percentile(frame(spark, a=x), SPEC, 0.3, w).orderBy("t").toPandas()["baseline"]
        assert np.allclose(got, pd.Series(x).rolling(w, center=True, min_periods=1).quantile(0.3))


def test_nearest_interp_and_range(spark):
    left = spark.createDataFrame([("a", 1.5), ("a", 3.1), ("a", 9.0)], "s string, x double")
    right = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0)], "s string, x double")
    assert {r["x"]: r["match"]["x"] for r in S.nearest(left, right, ["s"], "x").collect()} == {1.5: 2.0, 3.1: 4.0, 9.0: 4.0}
    assert {(r["x"], r["x_right"]) for r in S.range_join(left, right, ["s"], "x", 1.0, 0.5).collect()} == {(1.5, 1.0)}
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 2.0), ("a", 3.0, 0.0)], "s string, x double, y double")
    points = spark.createDataFrame([("a", v) for v in (-1.0, 0.5, 1.0, 2.0, 4.0)], "s string, x double")
    assert {r["x"]: r["y"] for r in S.interpolate(points, knots, ["s"], "x", "y").collect()} == {-1.0: -2.0, 0.5: 1.0, 1.0: 2.0, 2.0: 1.0, 4.0: -1.0}


def test_missing_values_and_dampening(spark):
    df = frame(spark, a=[1, 2, float("nan"), 4])
    assert S.moving(df, SPEC, 2).orderBy("t").toPandas()["moving_mean"].tolist() == [1, 1.5, 2, 4]
    damped = S.dampen(frame(spark, a=[1, 2, 4]), SPEC, 0.9).orderBy("t").toPandas()["damped"]
    assert np.allclose(damped, [0, 1, 2.9])


def test_unfold_and_errors(spark):
    df = frame(spark, a=range(10))
    got = S.unfold(df, SPEC, 4, 3).groupBy("window").agg(F.sort_array(F.collect_list("value")).alias("v")).orderBy("window").collect()
    assert [r["v"] for r in got] == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]
    with pytest.raises(ValueError):
        S.unfold(df, SPEC, 0, 1)
    with pytest.raises(ValueError):
        SeriesSpec((), ("t",))


def test_coherence_and_hilbert(spark):
    t = np.linspace(0, 1, 1000, endpoint=False)
    f, c = spectral.welch_coherence(np.sin(2 * math.pi * 5 * t), np.sin(2 * math.pi * 5 * t + math.pi / 4), nperseg=256)
    assert c[1] > 0.99 and len(f) == 129
    z = spectral.analytic(np.cos(2 * math.pi * 5 * t))
    assert np.allclose(np.abs(z), 1)
    df = frame(spark, a=np.cos(2 * math.pi * 5 * t))
    assert np.allclose(spectral.hilbert(df, SPEC).toPandas()["amplitude"], 1)


def test_pca_and_ridge(spark):
    x = np.random.default_rng(42).normal(size=(101, 20))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>").repartition(3)
    p = models.pca(df, "v", 5)
    c = x - x.mean(axis=0)
    s = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(p.variance, (s**2 / 100)[:5]) and np.allclose(p.ratio, (s**2 / (s**2).sum())[:5])
    got = np.array([r["scores"] for r in p.scores(df, "v").orderBy("i").collect()])
    assert np.allclose(got, c @ p.components.T)
    a, b = models.moments(df.where("i < 50"), "v"), models.moments(df.where("i >= 50"), "v")
    assert np.allclose(models.merge_moments(a, b).scatter, c.T @ c)


def test_polygon_and_angles(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    pts = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (0.0, 0.0), (3.0, 1.0), (1.0, 3.0)], "x double, y double")
    got = pts.select(M.in_polygon(F.col("x"), F.col("y"), square).alias("i"), M.polygon_distance(F.col("x"), F.col("y"), square).alias("d")).collect()
    assert [r["i"] for r in got] == [True, True, True, False, False] and [r["d"] for r in got] == [1, 0, 0, 1, 1]
    assert spark.range(1).select(scalar.circ_wrap(F.lit(-1.5), 2.0)).first()[0] == 0.5


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a1.txt").write_text("hello")
    found = tables.hash_files(spark, str(tmp_path / "in")).collect()
    assert found[0]["hash"] == "5d41402abc4b2a76b9719d911017c592"
    df = spark.range(3)
    tables.write_parquet(df, str(tmp_path / "p"))
    with pytest.raises(Exception):
        tables.write_parquet(df, str(tmp_path / "p"))
    u = spark.createDataFrame([("postgresql://me:pw@host:5432/db",)], "u string").select(tables.parse_url(F.col("u")).alias("u")).first()["u"]
    assert (u["dialect"], u["host"], u["port"], u["database"]) == ("postgresql", "host", 5432, "db")


def test_streaming_equals_batch(spark, tmp_path):
    df = frame(spark, a=[1, 2, 3, 4], b=[5, 6]).withColumn("at", F.timestamp_seconds(F.col("t") * 3600))
    df.write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
    q = online.windowed(stream, "at", "value", ["s"], "2 hours").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n"), F.sum("total")).first()[:] == (6, 21.0)
    q = online.online_moments(stream, "s", "value").writeStream.format("memory").queryName("m").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["s"]: (r["n"], r["mean"], r["m2"]) for r in spark.table("m").collect()}
    assert got == {"a": (4, 2.5, 5.0), "b": (2, 5.5, 0.5)}
