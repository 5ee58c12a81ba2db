"""Blocks of long series and polygons as tables, at their edges and against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators import matrix as M
from tidemark.operators import series as S
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(("s",), ("at", "id"))


@pytest.fixture(scope="module")
def rows(spark):
    """One series with most rows, ties in time, null times, null keys and null values."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(900), "s": rng.choice(["a", "b", None], 900, p=[0.8, 0.1, 0.1]), "at": rng.integers(0, 300, 900).astype(float), "value": rng.normal(size=900)})
    df = spark.createDataFrame(pdf, "id long, s string, at double, value double")
    return df.withColumns({"at": F.when(F.col("id") % 50 != 0, F.col("at")), "value": F.when(F.col("id") % 7 != 0, F.col("value"))})


def test_positions(rows):
    want = {r["id"]: r["t"] for r in SPEC.indexed(rows).collect()}
    for width in (1.0, 40.0, 1e6):
        got = B.long_positions(rows, SPEC, F.floor(F.col("at") / width))
        assert {r["id"]: r["t"] for r in got.collect()} == want and got.columns == [*rows.columns, "t"]
    assert B.long_positions(rows.limit(0), SPEC, F.floor("at")).count() == 0


def test_blocks(rows):
    placed = B.long_positions(rows, SPEC, F.floor(F.col("at") / 25))
    want = {r["id"]: (r["moving_mean"], r["baseline"]) for r in S.rolling_percentile(S.moving(rows, SPEC, 9), SPEC, 0.4, 12).collect()}
    both = lambda part, spec: S.rolling_percentile(S.moving(part, spec, 9), spec, 0.4, 12)
    for size in (1, 5, 64, 5000):
        got = B.in_blocks(placed, SPEC, size, 8, 5, both).collect()
        assert len(got) == 900 and {r["id"]: (r["moving_mean"], r["baseline"]) for r in got} == want
    with pytest.raises(ValueError):
        B.in_blocks(placed, SPEC, 0, 1, 1, both)


def test_polygons(spark):
    square = [("sq", 0, 0.0, 0.0), ("sq", 1, 4.0, 0.0), ("sq", 2, 4.0, 4.0), ("sq", 3, 0.0, 4.0)]
    notch = [("no", k, x, y) for k, (x, y) in enumerate([(2.0, -3.0), (9.0, -3.0), (9.0, 3.0), (5.5, -1.0), (2.0, 3.0)])]
    corners = spark.createDataFrame([*square, *notch, ("dot", 0, 1.0, 1.0)], "poly string, k int, px double, py double")
    rng = np.random.default_rng(4)
    places = [*map(tuple, rng.uniform(-4, 10, (200, 2)).tolist()), (0.0, 0.0), (4.0, 2.0), (2.0, 4.0), (1.0, 1.0), (1.0, 1.0), (4.1, 2.0), (None, 1.0), (float("nan"), 1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, x double, y double")
    want = {(r["id"], name) for name, shape in (("sq", square), ("no", notch)) for r in points.where("not isnan(x) and x is not null").where(M.in_polygon(F.col("x"), F.col("y"), [c[2:] for c in shape])).collect()}
    for cell in (0.7, 3.0, 100.0):
        got = [(r["id"], r["poly"]) for r in M.within_polygons(points, corners, "x", "y", cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want | {(203, "dot"), (204, "dot")}
    assert {(200, "sq"), (201, "sq"), (202, "sq")} <= want and (205, "sq") not in want
    assert M.within_polygons(points, corners.limit(0), "x", "y", 1.0).count() == 0


def test_event_windows_in_both_ways(rows, monkeypatch):
    def found():
        return sorted(map(tuple, S.event_windows(rows, SPEC, F.col("id") % 4 == 1, -3, 5).fillna(99.0, "value").fillna("-", "s").collect()))

    one_pass = found()
    monkeypatch.setattr(S, "FRAMES", 0)
    assert found() == one_pass and {r[0] for r in one_pass} == {"a", "b", "-"}
    t = {r["id"]: (r["s"] or "-", r["t"]) for r in SPEC.indexed(rows).collect()}
    value = {t[r["id"]]: 99.0 if r["value"] is None else r["value"] for r in rows.collect()}
    starts = [t[i] for i in t if i % 4 == 1]
    assert one_pass == sorted((s, at, o, value[s, at + o]) for s, at in starts if (s, at - 3) in value and (s, at + 4) in value for o in range(-3, 5))


def test_wide_percentiles(rows, monkeypatch):
    """Frames kept sorted hold what Spark's own frames do, to the bit, whatever the other columns hold."""
    odd = rows.withColumns({"big": F.when(F.col("id") % 3 == 0, F.col("id") + 2**60), "when": F.timestamp_seconds("id"), "list": F.array("id"), "value": F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 5 == 0, 0.5).otherwise(F.col("value"))})
    for width, p in ((1, 0.5), (6, 0.3), (75, 0.0), (200, 0.9), (4000, 1.0)):
        both = []
        for sliding in (0, 10_000):
            monkeypatch.setattr(S, "SLIDING", sliding)
            got = S.rolling_percentile(odd, SPEC, p, width)
            assert got.columns == [*odd.columns, "baseline"] and got.dtypes[:-1] == odd.dtypes
            both.append({r["id"]: (r["baseline"], r["big"], r["when"], r["list"], r["s"]) for r in got.collect()})
        assert len(both[0]) == 900 and both[0] == both[1]
    monkeypatch.setattr(S, "SLIDING", 0)
    assert S.rolling_percentile(odd.limit(0), SPEC, 0.5, 9).count() == 0
    again = S.rolling_percentile(S.rolling_percentile(odd, SPEC, 0.5, 9), SPEC, 0.5, 9)
    assert again.columns.count("baseline") == 1
