"""Values of operators that SQL can't express, against numpy and known numbers."""

import io
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import bases, distributions, nested
from tidemark.operators import images as I
from tidemark.operators import matrix as M
from tidemark.operators import positions as P
from tidemark.operators import series as S
from tidemark.operators import spectral
from tidemark.operators import statistics as T
from tidemark.plans import models, tensors, tuner
from tidemark.sources import tables
from tidemark.spec import SeriesSpec
from tidemark.streaming import online

SPEC = SeriesSpec(("s",), ("t",))


def frame(spark, **series):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"s": k, "t": range(len(v)), "value": np.asarray(v, float)}) for k, v in series.items()]))


def test_distributions(spark):
    # values of printed tables
    assert np.allclose(distributions.normal_tail(np.array([0, 1.959963985, -1, 3])), [0.5, 0.025, 0.841344746, 0.001349898], atol=1e-9)
    assert np.allclose(distributions.normal_quantile(np.array([0.5, 0.975, 0.0, 1.0])), [0, 1.959963985, -np.inf, np.inf])
    assert np.allclose(distributions.student_quantile(0.975, np.array([1, 2, 5, 10, 30, 120])), [12.7062047, 4.3026527, 2.5705818, 2.2281389, 2.0422725, 1.9799304], atol=1e-6)
    assert np.allclose(distributions.student_tail(np.array([0, 2.2281389, -2.2281389, 12.7062047]), np.array([10, 10, 10, 1])), [0.5, 0.025, 0.975, 0.025], atol=1e-8)
    df = spark.createDataFrame([(1.959963985, 0.05, 10), (None, None, None)], "z double, p double, n int")
    got = df.select(distributions.p_of_z(F.col("z")).alias("a"), distributions.p_of_z(F.col("z"), False).alias("b"), distributions.z_of_p(F.col("p")).alias("c"), distributions.p_of_t(F.col("z"), F.col("n")).alias("d"),
                    distributions.t_of_p(0.975, F.col("n")).alias("e")).collect()
    assert np.allclose(tuple(got[0]), (0.05, 0.025, 1.959963985, 0.07845, 2.2281389), atol=1e-4) and all(v is None for v in got[1])


def test_intervals_and_policies(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 5)] + [("b", float("nan")), ("b", 2.0), ("b", 0.0)], "k string, x double")
    got = {r["k"]: r for r in T.error_interval(df, ["k"], "x", "ci").collect()}
    x = np.array([1, 2, 4, 5.0])
    half = x.std() / 2 * 3.1824463
    assert np.allclose((got["a"]["lower"], got["a"]["upper"]), (x.mean() - half, x.mean() + half), atol=1e-6)
    assert math.isnan({r["k"]: r["mean"] for r in T.error_interval(df, ["k"], "x", "sem", missing="propagate").collect()}["b"])
    with pytest.raises(Exception, match="missing values"):
        T.error_interval(df, ["k"], "x", missing="raise").collect()
    with pytest.raises(ValueError):
        T.error_interval(df, ["k"], "x", "none")
    mean = lambda **how: {r["k"]: r["geometric_mean"] for r in T.geometric_mean(df, ["k"], "x", **how).collect()}["b"]
    assert mean() == 0 and abs(mean(zeros="nan") - 2) < 1e-12
    with pytest.raises(Exception, match="zeros"):
        mean(zeros="raise")


def test_two_samples(spark):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.normal(0, 1, 40), 1), np.round(rng.normal(0.4, 2, 55), 1)
    df = spark.createDataFrame([("g", float(v), False) for v in a] + [("g", float(v), True) for v in b], "k string, x double, second boolean")
    r = T.two_sample_tests(df, ["k"], "x", F.col("second")).first()
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    pooled = ((39 * a.var(ddof=1) + 54 * b.var(ddof=1)) / 93) ** 0.5
    t = (a.mean() - b.mean()) / (pooled * (1 / 40 + 1 / 55) ** 0.5)
    assert r["u"] == u and abs(r["t"] - t) < 1e-9
    assert abs(r["t_two"] - 2 * float(distributions.student_tail(abs(t), 93))) < 1e-9 and abs(r["t_greater"] + r["t_less"] - 1) < 1e-9
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    sd = (40 * 55 / 12 * (96 - (counts.astype(float) ** 3 - counts).sum() / (95 * 94))) ** 0.5
    upper = float(distributions.normal_tail((u - 1100 - 0.5) / sd))
    assert abs(r["u_greater"] - upper) < 1e-9 and abs(r["u_two"] - min(1, 2 * min(upper, r["u_less"]))) < 1e-12


def test_nearest_over_long_series(spark):
    rng = np.random.default_rng(3)
    x, y = np.sort(rng.integers(0, 10**6, 3000)), np.unique(rng.integers(0, 10**6, 50))
    left = spark.createDataFrame([("a", int(v)) for v in x], "s string, x long")
    right = spark.createDataFrame([("a", int(v)) for v in y], "s string, x long")
    for r in S.nearest(left, right, ["s"], "x").collect():
        gap = np.abs(y - r["x"])
        assert r["match"]["x"] == y[gap == gap.min()].max()


def test_bases():
    m = bases.m_splines(3, 7, 400)
    knots = np.concatenate([np.zeros(2), np.linspace(0, 1, 6), np.ones(2)])
    assert np.allclose((m * ((knots[3:] - knots[:-3]) / 3)[:, None]).sum(axis=0), 1)  # B-splines of the same knots add up to one
    assert np.allclose(m[:, :-1].sum(axis=1) / 400, 1, atol=0.2)
    with pytest.raises(ValueError):
        bases.m_splines(4, 3, 10)
    c = bases.raised_cosines(6, 300)
    assert c.shape == (300, 6) and np.allclose(c.sum(axis=1), 1, atol=0.02) and c[0, 0] > 0.999 and c[-1, -1] > 0.999
    warped = bases.raised_cosines(6, 300, warp=np.arange(1000) ** 2)
    assert np.argmax(warped[:, 2]) > np.argmax(c[:, 2])


def test_path(spark):
    previous = spark.createDataFrame([(9, 1, 4), (9, 4, 9), (9, 5, -9999), (8, 1, 8)], "target long, node long, previous long")
    walk = lambda a, b: [r["node"] for r in P.path_between(previous, a, b).orderBy("step").collect()]
    assert walk(1, 9) == [1, 4, 9] and walk(1, 8) == [1, 8] and walk(5, 9) == [5] and walk(9, 9) == [9]


def test_dbscan(spark, tmp_path):
    rng = np.random.default_rng(1)
    line = np.column_stack([np.linspace(0, 30, 160), np.zeros(160)])  # a chain longer than any fixed number of rounds
    pts = np.concatenate([line, rng.normal([5, 9], 0.2, (60, 2)), rng.uniform(12, 40, (40, 2))])
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = {r["i"]: r["cluster"] for r in models.dbscan(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "i long, x double, y double"), "i", "x", "y", 0.5, 4).collect()}
    near = np.hypot(*(pts[:, None] - pts[None]).transpose(2, 0, 1)) <= 0.5
    core = near.sum(axis=1) >= 4
    label = np.where(core, np.arange(len(pts)), 10**6)
    while True:
        new = np.where(core, np.where(near & core[None] & core[:, None], label[None], 10**6).min(axis=1), 10**6)
        if (new == label).all():
            break
        label = new
    want = [label[i] if core[i] else np.where(near[i] & core, label, 10**6).min() for i in range(len(pts))]
    assert got == {i: -1 if w == 10**6 else w for i, w in enumerate(want)}
    assert len({got[i] for i in range(160)}) == 1


def test_ridge_sweep_and_reduced_rank(spark):
    rng = np.random.default_rng(2)
    x, e = rng.normal(size=(300, 3)), rng.normal(size=300)
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.1 * e
    df = spark.createDataFrame([("k", i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "k string, i long, a double, b double, c double, y double")
    fold = np.array([r["f"] for r in df.select("i", models.fold_of(3, "i").alias("f")).orderBy("i").collect()])
    for r in models.ridge_sweep(df, ["k"], ["a", "b", "c"], "y", [0.0, 50.0], group=["i"]).collect():
        tr, te = fold != r["fold"], fold == r["fold"]
        m, my = x[tr].mean(axis=0), y[tr].mean()
        theta = np.linalg.solve((x[tr] - m).T @ (x[tr] - m) + r["alpha"] * np.eye(3), (x[tr] - m).T @ (y[tr] - my))
        b = my - theta @ m
        ev = 1 - ((y[te] - x[te] @ theta - b) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum()
        assert np.allclose(r["theta"], theta) and abs(r["intercept"] - b) < 1e-9 and abs(r["ev_test"] - ev) < 1e-9
    assert models.best_alpha(models.ridge_sweep(df, ["k"], ["a", "b", "c"], "y", [0.0, 5000.0], group=["i"]), ["k"]).first()["alpha"] == 0.0
    z = np.column_stack([y, 2 * y + 0.01 * e, -y])
    wide = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(x, z, strict=True)], "a double, b double, c double, p double, q double, r double")
    coefficients = models.reduced_rank(wide, ["a", "b", "c"], ["p", "q", "r"], 1)
    assert np.linalg.matrix_rank(coefficients, tol=1e-6) == 1 and np.allclose(coefficients[:, 0], [1, -2, 0.5], atol=0.03)


def test_group_split(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("g")).withColumn("f", models.fold_of(5, "g"))
    got = df.groupBy("g").agg(F.count_distinct("f").alias("n")).where("n > 1").count()
    assert got == 0 and df.select("f").distinct().count() == 5


def test_components_restored_and_whitened(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    p = models.pca(df, "v", 5)
    back = np.array([r["restored"] for r in p.restored(p.scores(df, "v")).orderBy("i").collect()])
    assert np.allclose(back, x)
    white = np.array([r["whitened"] for r in p.zca(df, "v", 200, 0.0).orderBy("i").collect()])
    c = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(white, c @ (v.T @ np.diag(1 / s) @ v)) and np.allclose(np.corrcoef(white.T), np.eye(5), atol=1e-6)
    weights = np.array([1.0, 2.0])
    assert np.allclose(models.unmixed(p.components.T, weights), p.components.T[:, :2] @ weights[:, None])


def test_tensor_factors(spark):
    rng = np.random.default_rng(5)
    true = [rng.random((n, 2)) for n in (6, 5, 4)]
    dense = np.einsum("ar,br,cr->abc", *true)
    df = spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(dense) for i in [i]], "i0 long, i1 long, i2 long, v double").repartition(3)
    got = tensors.fit(df, dense.shape, 2, sweeps=60)
    assert all((m >= 0).all() for m in got.matrices) and got.shares[-1] > 0.999 and np.diff(got.shares).min() > -1e-9
    model = M.from_factors(got.rows(df))
    assert tensors.explained_variance(df, model, 3).first()[0] > 0.99


def test_tuner(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    y = x @ [2.0, 0, 0, -1] + 0.3 * rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(v), float(v > 0)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double, y double, z double")
    found = tuner.tune_regression(df, list("abcd"), "y", trials=12, batch=6, patience=12)
    assert len(found.trials) == 12 and found.loss == found.trials["loss"].min() < 0.05 and found.params["alpha"] < 100
    again = tuner.tune_regression(df.repartition(7), list("abcd"), "y", trials=12, batch=6, patience=12)
    assert again.params == found.params and np.allclose(again.trials["loss"], found.trials["loss"])
    classes = tuner.tune_classifier(df, list("abcd"), "z", trials=40, batch=8, patience=8, tol_frac=0.5)
    assert classes.loss < 0.4 and len(classes.trials) < 40
    drawn = tuner.drawn({"a": [1, 2], "n": ("int", 3, 5), "u": ("uniform", 0, 1), "l": ("log", 0.1, 10)}, 3, 0)
    assert drawn["a"] in (1, 2) and 3 <= drawn["n"] <= 5 and 0 <= drawn["u"] <= 1 and 0.1 <= drawn["l"] <= 10


def test_spectral_values(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=500), rng.normal(size=500)
    df = frame(spark, a=x).withColumn("other", F.lit(0.0)).drop("other").join(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "s string, t long, other double"), ["s", "t"])
    for how in ({"nperseg": 64}, {"nperseg": 50, "noverlap": 10, "nfft": 128, "window": "hamming", "detrend": "linear"}, {"nperseg": 128, "window": "boxcar", "fs": 10.0}):
        fs = how.pop("fs", 1.0)
        got = spectral.coherence(df, SPEC, "other", fs, **how).orderBy("frequency").toPandas()
        f, c = spectral.welch_coherence(x, y, fs, **how)
        assert np.allclose(got["frequency"], f) and np.allclose(got["coherence"], c)
    kernel = [1.0, 2.0, -1.0, 0.5]
    for mode, want in (("full", np.convolve(x, kernel)), ("valid", np.convolve(x, kernel, "valid")), ("same", np.convolve(x, kernel)[2:502])):
        assert np.allclose(spectral.fft_convolve(frame(spark, a=x), SPEC, kernel, mode).orderBy("t").toPandas()["conv"], want)
    assert np.allclose(S.convolve(frame(spark, a=x), SPEC, kernel, "same_late").orderBy("t").toPandas()["conv"], np.convolve(x, kernel)[2:502])
    assert np.allclose(spectral.reversed_in_time(x), x[::-1])
    t = np.arange(1000) / 1000
    wave = pd.DataFrame({"s": "a", "t": range(1000), "value": np.sin(2 * np.pi * 5 * t), "other": np.sin(2 * np.pi * 5 * t + 0.7)})
    assert abs(spectral.angle_difference(spark.createDataFrame(wave), SPEC, "other").first()["angle"] + 0.7) < 1e-6
    mixed = frame(spark, a=np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 100 * t) + 3)
    band = spectral.butter_bandpass(mixed, SPEC, 1, 20, 1000, 6).orderBy("t").toPandas()["filtered"]
    assert np.abs(band - np.sin(2 * np.pi * 5 * t)).max() < 0.01
    shifted = spectral.phase_shift(frame(spark, a=np.cos(2 * np.pi * 5 * t)), SPEC, np.pi / 2).orderBy("t").toPandas()["shifted"]
    assert np.allclose(shifted, -np.sin(2 * np.pi * 5 * t))
    taps = [0.25, 0.5, 0.25]
    smooth = spectral.filtfilt(frame(spark, a=x), SPEC, taps).orderBy("t").toPandas()["filtered"]
    twice = np.convolve(np.convolve(x, taps), taps[::-1])[2:-2]
    assert np.allclose(smooth, twice)
    power = spectral.morlet(frame(spark, a=np.sin(2 * np.pi * 5 * t)), SPEC, [2.0, 5.0, 12.0], 1000.0).groupBy("frequency").agg(F.avg("power").alias("p")).toPandas().set_index("frequency")["p"]
    assert power.idxmax() == 5.0
    tapers = spectral.slepian(64, 2.5, 4)
    assert np.allclose(tapers @ tapers.T, np.eye(4), atol=1e-9)
    grams = spectral.multitaper(frame(spark, a=np.sin(2 * np.pi * t * 125)), SPEC, 64, 32).groupBy("frequency").agg(F.avg("power").alias("p")).toPandas()
    assert abs(grams.loc[grams["p"].idxmax(), "frequency"] - 0.125) < 1 / 64


def test_sorted_event_average(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=200)
    df = frame(spark, a=x, b=x[::-1])
    flag = F.col("t") % 10 == 5
    win = S.event_windows(df, SPEC, flag, -2, 3).withColumn("train", F.pmod(F.xxhash64(F.lit(0), "s", "event"), F.lit(2)) == 0).toPandas()
    got = S.sorted_event_average(df, SPEC, flag, -2, 3).toPandas().set_index(["s", "offset"])
    for (s, o), part in win.groupby(["s", "offset"]):
        assert np.isclose(got.loc[(s, o), "train"], part.loc[part["train"], "value"].mean()) and np.isclose(got.loc[(s, o), "test"], part.loc[~part["train"], "value"].mean())
    for s in "ab":
        mine = got.loc[s]
        assert (mine["peak"] == mine["train"].idxmax()).all()


def long(spark, **images):
    return spark.createDataFrame([(k, y, x, float(v)) for k, a in images.items() for (y, x), v in np.ndenumerate(a)], "img string, y long, x long, v double")


def test_images(spark):
    rng = np.random.default_rng(9)
    a = rng.random((16, 20))
    moved = {f"m{dy}_{dx}": np.roll(a, (dy, dx), (0, 1)) for dy, dx in ((0, 0), (3, -4), (-2, 5))}
    got = {r["img"]: (r["dy"], r["dx"]) for r in I.translation_shifts(long(spark, **moved), a).collect()}
    assert got == {f"m{dy}_{dx}": (dy, dx) for dy, dx in ((0, 0), (3, -4), (-2, 5))}
    yy, xx = np.mgrid[0:4, 0:5]
    ramp = 2.0 * yy + 3.0 * xx
    big = I.resize(long(spark, a=ramp), 4, 5, (7, 9)).toPandas().pivot(index="y", columns="x", values="v").to_numpy()
    assert np.allclose(big, 2 * np.linspace(0, 3, 7)[:, None] + 3 * np.linspace(0, 4, 9)[None])
    flat = I.flatten_channels(spark.createDataFrame([(i, c, 1.0) for i in range(3) for c in range(2)], "img long, c long, v double"), 2)
    assert sorted(r["img"] for r in flat.collect()) == list(range(6))
    assert {(r["img"], r["c"]) for r in I.unflatten_channels(flat, 2).collect()} == {(i, c) for i in range(3) for c in range(2)}
    hidden = I.occlude(long(spark, a=np.ones((10, 10)), b=np.ones((10, 10))), 10, 10).groupBy("img").agg(F.sum("v").alias("v")).collect()
    assert all(75 <= r["v"] <= 91 for r in hidden)
    scaled = I.multiply_at_random(long(spark, a=np.ones((2, 2)), b=np.ones((2, 2))), 2, 3).groupBy("img").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()
    assert all(2 <= r["a"] == r["b"] < 3 for r in scaled)
    with pytest.raises(Exception, match="NaN"):
        I.without_nan(long(spark, a=np.array([[np.nan]]))).collect()
    moved = I.footprints(spark.createDataFrame([(1, 10, 10, 1.0), (1, 12, 10, 1.0)], "roi int, y long, x long, v double"), 5).collect()
    assert {(r["y"], r["x"]) for r in moved} == {(1, 2), (3, 2)}


def test_sources_and_catalog(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(4, 3))
    got = tables.read_arrays(spark, str(tmp_path)).orderBy("i").collect()
    assert [r["row"] for r in got] == np.arange(12.0).reshape(4, 3).tolist()
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        z.writestr("d/x.txt", "hello")
    (tmp_path / "z.zip").write_bytes(content.getvalue())
    assert [(r["name"], bytes(r["content"])) for r in tables.read_archives(spark, str(tmp_path)).collect()] == [("d/x.txt", b"hello")]
    (tmp_path / "j.json").write_text('{"a": 1}')
    assert tables.read_json(spark, str(tmp_path / "j.json")).first()["a"] == 1
    tables.write_json(spark.range(2), str(tmp_path / "out"))
    tables.append_csv(spark.range(2), str(tmp_path / "csv"))
    tables.append_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    names = sorted((r["name"] for r in tables.find_paths(spark, str(tmp_path), name_matches=r"^[ajz]\.").collect()))
    assert names == ["a.npy", "j.json", "z.zip"]
    order = spark.createDataFrame([("img10",), ("img2",)], "n string").orderBy(*tables.natural_order(F.col("n"))).collect()
    assert [r["n"] for r in order] == ["img2", "img10"]
    tables.create_database(spark, "catalog_test")
    spark.sql("use catalog_test")
    tables.create_table(spark, "t1", {"a": "int", "b": "string"})
    assert [r["col_name"] for r in tables.columns(spark, "t1").collect()] == ["a", "b"] and tables.tables(spark, "catalog_test").where("tableName = 't1'").count() == 1
    assert tables.databases(spark).where("namespace = 'catalog_test'").count() == 1
    tables.drop_table(spark, "t1")
    spark.sql("use default")
    tables.drop_database(spark, "catalog_test")
    assert tables.databases(spark).where("namespace = 'catalog_test'").count() == 0


def test_nested_values(spark):
    df = spark.createDataFrame([((1, ("x", 2.0)), {"a": 1, "b": 2})], "s struct<n: int, d: struct<t: string, f: double>>, m map<string, int>")
    assert nested.flattened(df).columns == ["s.n", "s.d.t", "s.d.f", "m"] and nested.find_keys(df, r"\.t$") == ["s.d.t"]
    got = df.select(nested.with_key(F.col("s"), "d.t", F.lit("y")).alias("s"), nested.inverted(F.col("m")).alias("i"), nested.map_values(F.col("m"), lambda v: v * 10).alias("v")).first()
    assert got["s"]["d"]["t"] == "y" and got["i"] == {1: "a", 2: "b"} and got["v"] == {"a": 10, "b": 20}


def test_sessions_and_batches_of_a_stream(spark, tmp_path):
    df = frame(spark, a=[1, 2, 3, 4], b=[5, 6]).withColumn("at", F.timestamp_seconds(F.col("t") * F.when(F.col("t") > 2, 7200).otherwise(60)))
    df.write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
    q = online.sessions(stream, "at", ["s"], "10 minutes").writeStream.format("memory").queryName("ses").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["s"], r["n"]) for r in spark.table("ses").collect()) == [("a", 1), ("a", 3), ("b", 2)]
    seen = []
    q = online.partial_fit(stream, lambda part, n: seen.append((n, part.count())), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sum(n for _, n in seen) == 6


def test_rank_ranges(spark):
    rng = np.random.default_rng(10)
    v = rng.integers(-50, 10_000, 3000)
    got = {r["x"]: r["squeezed"] for r in T.squeeze(spark.createDataFrame([(int(a),) for a in v], "x long"), "x", buckets=7).collect()}
    assert got == {int(a): i + int(v.min()) for i, a in enumerate(np.unique(v))}
    with pytest.raises(ValueError):
        T.confusion(spark.createDataFrame([(i, i) for i in range(50)], "p int, t int"), "p", "t", most=100)


def test_assignment_and_permutation(spark):
    import itertools

    rng = np.random.default_rng(11)
    for n, m in ((1, 1), (4, 4), (5, 3), (3, 6), (6, 6)):
        score = rng.normal(size=(n, m))
        got = M.assignment(score)
        total = sum(score[i, k] for i, k in enumerate(got) if k >= 0)
        best = max(sum(score[i, k] for i, k in enumerate(p)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(score[i, k] for k, i in enumerate(p)) for p in itertools.permutations(range(n), m))
        assert abs(total - best) < 1e-9 and len({k for k in got if k >= 0}) == min(n, m)
    a = rng.normal(size=(30, 5))
    turn = rng.permutation(5)
    b = a[:, turn] + 0.01 * rng.normal(size=a.shape)
    cells = lambda x: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "i long, j long, v double")
    for kind in ("pearson", "cosine"):
        got = M.best_permutation(cells(a), cells(b), kind)
        assert all(turn[q] == p and s > 0.99 for p, q, s in got) and len(got) == 5


def test_point_density(spark):
    rng = np.random.default_rng(12)
    pts, bins, sigma = rng.normal(size=(400, 2)), (16, 12), 1.3
    got = M.point_density(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "i int, x double, y double"), "x", "y", bins, sigma).orderBy("i").toPandas()["density"]
    h, _, _ = np.histogram2d(*pts.T, bins=bins)
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    for axis in (0, 1):
        h = np.apply_along_axis(lambda r: np.convolve(np.pad(r, reach, mode="edge"), w / w.sum(), "valid"), axis, h)
    g = [(c - c.min()) / (c.max() - c.min() + 1e-12) * (n - 1) for c, n in zip(pts.T, bins, strict=True)]
    lo = [np.minimum(a.astype(int), n - 2) for a, n in zip(g, bins, strict=True)]
    f = [a - b for a, b in zip(g, lo, strict=True)]
    want = sum(h[lo[0] + p, lo[1] + q] * (f[0] if p else 1 - f[0]) * (f[1] if q else 1 - f[1]) for p in (0, 1) for q in (0, 1))
    assert np.allclose(got, want, atol=1e-6)


def test_rotations_and_orthonormal(spark):
    rng = np.random.default_rng(13)
    a = rng.normal(size=(80, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, a @ turn, strict=True))], "i int, a array<double>, b array<double>").repartition(3)
    got, scale = models.procrustes(df, "a", "b")
    assert np.allclose(got, turn) and abs(scale - np.linalg.svd(a.T @ (a @ turn), compute_uv=False).sum()) < 1e-6
    out = np.array([r["orthonormal"] for r in models.nearest_orthonormal(df, "a").orderBy("i").collect()])
    u, _, v = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
    assert np.allclose(out, u @ v) and np.allclose(out.T @ out, np.eye(3))
    p = models.incremental_pca([df.where("i < 30"), df.where("i >= 30"), df.where("i > 900")], "a", 2)
    assert np.allclose(p.variance, models.pca(df, "a", 2).variance) and np.allclose(p.components, models.pca(df, "a", 2).components)


def test_orthogonalise_many(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(100, 2))
    y = np.column_stack([x @ [1.0, 2.0] + rng.normal(size=100), rng.normal(size=100)]) + 5
    df = spark.createDataFrame([(i, *map(float, (*a, *b, a[0] * 2))) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, p double, q double, c double")
    rest, share, total = models.orthogonalise_from(df, ["p", "q"], ["a", "b", "c"])  # c repeats a
    got = rest.orderBy("i").select("p_rest", "q_rest").toPandas().to_numpy()
    full = np.column_stack([x - x.mean(axis=0)])
    want = y - full @ np.linalg.lstsq(full, y - y.mean(axis=0), rcond=None)[0]
    assert np.allclose(got, want) and np.allclose([share["p"], share["q"]], 1 - want.var(axis=0) / y.var(axis=0)) and abs(total - (1 - want.var(axis=0).sum() / y.var(axis=0).sum())) < 1e-9
    means = x.mean(axis=0), y.mean(axis=0)
    w = np.linalg.lstsq(full, y - means[1], rcond=None)[0]
    predicted = np.array([r["predicted"] for r in models.predicted(df, ["a", "b"], w, means).orderBy("i").collect()])
    assert np.allclose(predicted, full @ w + means[1])


def test_splits_batches_and_chunks(spark):
    df = spark.range(2000).select((F.col("id") % 100).alias("g"), "id")
    s = models.shuffle_splits(df, ["g"], 3, 0.3)
    assert s.count() == 6000 and s.groupBy("split", "g").agg(F.count_distinct("test").alias("n")).where("n > 1").count() == 0
    share = s.groupBy("split").agg(F.avg(F.col("test").cast("int")).alias("m")).collect()
    assert all(0.1 < r["m"] < 0.5 for r in share)
    sizes = [r["count"] for r in P.random_batches(df, 100, 1, "id").groupBy("batch").count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 2000 and max(sizes) < 160
    chunks = P.random_chunks(frame(spark, a=range(50), b=range(7)), SPEC, 8).groupBy("s", "chunk").agg(F.array_sort(F.collect_list("value")).alias("v")).collect()
    assert all(len(r["v"]) == 8 and r["v"][-1] - r["v"][0] == 7 for r in chunks) and len([r for r in chunks if r["s"] == "a"]) >= 5 and not [r for r in chunks if r["s"] == "b"]


def test_more_images(spark):
    a = np.arange(20.0).reshape(4, 5)
    moved = I.shift_images(long(spark, a=a), spark.createDataFrame([("a", 1.0, -0.5)], "img string, dy double, dx double"), 4, 5).toPandas().pivot(index="y", columns="x", values="v")
    full = np.zeros((4, 5))
    for y in range(3):
        for x in range(5):
            for k, w in ((x - 1, 0.5), (x, 0.5)):
                if 0 <= k < 5:
                    full[y + 1, k] += w * a[y, x]
    assert np.allclose(moved.reindex(index=range(4), columns=range(5)).fillna(0).to_numpy(), full)
    ident = long(spark, a=a).select("img", "y", "x", F.col("y").cast("double").alias("map_y"), F.col("x").cast("double").alias("map_x"))
    half = ident.withColumns({"map_y": F.col("y") + 0.5, "map_x": F.col("x") * 0.5})
    got = I.compose_maps(ident, half).toPandas()
    assert len(got) == 15 and np.allclose(got["map_y"], got["y"] + 0.5) and np.allclose(got["map_x"], got["x"] * 0.5)
    noisy = I.poisson_noise(long(spark, a=np.full((30, 30), 4.0)), 10.0).toPandas()["v"]
    assert abs(noisy.mean() - 4) < 0.1 and abs(noisy.var() - 0.4) < 0.1
    striped = I.scale_stripes(long(spark, a=np.ones((4, 2)))).groupBy((F.col("y") % 2).alias("odd")).agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()
    assert all(0.5 <= r["a"] == r["b"] < 1 for r in striped)
    shifted = I.shift_stripes(long(spark, a=np.tile(np.arange(10.0), (2, 1))), 10, 4, 4).toPandas()
    gap = (shifted["x"] - shifted["v"]).groupby(shifted["y"]).first()
    assert abs(gap[1] - gap[0]) == 4


def test_samples(spark):
    from tidemark.plans import samples

    pts = samples.correlated_2d(spark, [(0, 0), (5, 1)], [(1, 2), (1, 1)], [0.8, -0.5], [4000, 3000]).toPandas()
    one = pts[pts["mode"] == 0]
    assert len(pts) == 7000 and abs(np.corrcoef(one["x"], one["y"])[0, 1] - 0.8) < 0.05 and abs(one["y"].std() - 2) < 0.1
    v = spark.range(5000).select(samples.log_uniform(1, 100, 3).alias("v")).toPandas()["v"]
    assert v.between(1, 100).all() and abs(np.log10(v).mean() - 1) < 0.05
    assert samples.map_items(spark, lambda x: x * x, range(7)) == [x * x for x in range(7)] and samples.map_items(spark, str, []) == []
    got = samples.map_vectors(spark.createDataFrame([([3.0, 1.0, 2.0],)], "v array<double>"), "v", np.sort, "s").first()["s"]
    assert got == [1, 2, 3]


def test_masks_of_frequencies():
    # an independent sum over the axes, and the magnitudes at the cuts of the digital filter
    m = I.butterworth_mask((6, 9), 0.25, 3)
    far = ((np.fft.ifftshift(np.arange(6) - 2.5) / 1.5) ** 2)[:, None] + ((np.fft.ifftshift(np.arange(9) - 4) / 2.25) ** 2)[None]
    assert np.allclose(m, 1 / (1 + far**3))
    assert np.allclose(I.butterworth_mask((6, 9), 0.25, 3, high_pass=True), 1 - m) and np.allclose(I.butterworth_mask((6, 9), 0.25, 3, real=True, squared=False), np.sqrt(m[:, :5]))
    low, band = I.ring_mask(32, 40, 0, 6), I.ring_mask(32, 40, 5, 9)
    assert low[16, 20] == 1 and np.isclose(low[16, 26], 0.5**0.5) and low[0, 0] < 1e-3
    assert band[16, 20] == 0 and np.isclose(band[16, 25], 0.5**0.5) and np.isclose(band[16, 29], 0.5**0.5) and band[16, 27] > 0.99


def _images(spark, arrays):
    rows = [(k, y, x, float(a[y, x])) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "img long, y long, x long, v double")


def test_alignment_and_depths(spark):
    rng = np.random.default_rng(12)
    stack = rng.normal(size=(5, 16, 20))
    got = {r["img"]: r for r in I.alignment_scores(_images(spark, [stack[0], np.roll(stack[0], (0, 1), (0, 1)), np.roll(stack[0], 6, 1), stack[1]]), stack[0], 2.0, 4.0).collect()}
    c = I.correlation_image(stack[0], stack[0])
    near, away = I.ring_mask(16, 20, 0, 2.0), I.ring_mask(16, 20, 4.0, 8.0)
    assert np.isclose(got[0]["max_in"], 1, atol=1e-3) and np.isclose(got[0]["mean_in"], (c * near).sum() / near.sum()) and np.isclose(got[0]["std_out"], np.sqrt(((c - (c * away).sum() / away.sum()) ** 2 * away).mean()))
    assert got[0]["z_in"] > got[1]["z_in"] > max(got[2]["max_diff"] * 5, got[3]["z_in"]) and got[2]["max_in"] < 0.3
    mixed = 0.5 * stack[2] + 0.5 * stack[3]
    deep = {r["img"]: r["depth"] for r in I.depths(_images(spark, [stack[2], mixed, stack[0]]), stack, np.arange(5) * 10.0, sigma=1.0).collect()}
    assert abs(deep[0] - 20) < 3 and 21 < deep[1] < 29 and deep[2] == 0


def test_scaled_waves():
    x = np.linspace(-0.5, 0.5, 21)
    cubic = lambda t: 3 * t**3 - t**2 + 0.5 * t - 2
    for n in (4, 5, 6, 21):
        y = cubic(np.linspace(-0.5, 0.5, n))
        assert np.allclose(bases.even_spline(y, (np.linspace(-0.5, 0.5, 37) + 0.5) * (n - 1)), cubic(np.linspace(-0.5, 0.5, 37)))
    waves = bases.scaled_waves(np.cos(np.linspace(-2 * np.pi, 2 * np.pi, 2001)), [50, 100], [100, 100])
    for (at, wave), length in zip(waves, (50, 100), strict=True):
        assert len(wave) == 100 and np.allclose(wave, np.where(np.abs(at) <= 0.5, np.cos(4 * np.pi * at), 0), atol=1e-8) and np.isclose(at[-1], 50 / length)
    assert np.allclose(bases.scaled_waves(x, [11], kind="linear")[0][1], np.linspace(-0.5, 0.5, 11)) and np.allclose(bases.scaled_waves(x, [21], kind="nearest", fill=7)[0][1], x)
    with pytest.raises(ValueError):
        bases.scaled_waves(x, [5], kind="septic")


def test_traces_and_yaml(spark, tmp_path):
    for name, only in (("one", ("F", "Fneu", "spks", "iscell")), ("two", ("F",))):
        (tmp_path / name).mkdir()
        for k, n in enumerate(only):
            np.save(tmp_path / name / f"{n}.npy", np.array([[1, 0.9], [0, 0.2]]) if n == "iscell" else np.arange(6.0).reshape(2, 3) + 10 * k)
    np.save(tmp_path / "one" / "stat.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    got = [tuple(r) for r in tables.read_traces(spark, str(tmp_path)).withColumn("folder", F.regexp_extract("folder", "([^/]*)$", 1)).orderBy("folder", "roi", "t").collect()]
    assert got == [("one", i, t, 3.0 * i + t, 10 + 3.0 * i + t, 20 + 3.0 * i + t, 1.0 - i) for i in range(2) for t in range(3)] + [("two", i, t, 3.0 * i + t, None, None, None) for i in range(2) for t in range(3)]
    pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text("x: [1, 2]\nwhen: 2020-01-02\n")
    (tmp_path / "b.yaml").write_text("# nothing")
    (tmp_path / "c.yaml").write_text("")
    assert [r["value"] for r in tables.read_yaml(spark, str(tmp_path)).orderBy("path").collect()] == ['{"x": [1, 2], "when": "2020-01-02"}', "null"]
