"""Basis functions: small tables made on the driver, and expansions of columns by them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def raised_cosines(n: int, size: int = 500, cropped: bool = True, warp: np.ndarray | None = None, fine: int = 10) -> np.ndarray:
    """(size, n) table of n raised cosines, each half a width after the one before; cropped at the peaks of the first and last.

    They are laid out on a grid ``fine`` times as dense. ``warp``, an increasing curve, bends the axis.
    """
    points = size * fine
    width = int(points / (n + 1) * 2)
    bump = (1 - np.cos(np.linspace(0, 2 * np.pi, width))) / 2
    dense = np.zeros((points, n))
    for i in range(n):
        at = int(width * i / 2)
        part = bump[: points - at]
        dense[at : at + len(part), i] = part
    if cropped:
        dense = dense[width // 2 : points - width // 2]
    place = np.linspace(0, 1, size)
    if warp is not None:
        curve = (np.asarray(warp, float) - np.min(warp)) / (np.max(warp) - np.min(warp))
        place = curve[np.round(place * (len(curve) - 1)).astype(int)]
    place = place * (len(dense) - 1)
    return np.column_stack([np.interp(place, np.arange(len(dense)), c) for c in dense.T])


def expanded(df: DataFrame, value: str, axis: Sequence[float], table: np.ndarray, out: str = "basis") -> DataFrame:
    """Adds the array of basis values at the axis point nearest to the value, the lower on ties. The axis is evenly spaced.

    The table is small and made by the caller, so it goes along with the plan.
    """
    low, step = float(axis[0]), float(axis[-1] - axis[0]) / max(len(axis) - 1, 1)
    place = F.ceil((F.col(value) - low) / step - 0.5) if step else F.lit(0)
    place = F.greatest(F.lit(0), F.least(F.lit(len(axis) - 1), place)).cast("int")
    rows = df.sparkSession.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(table)], f"_place int, {out} array<double>")
    return df.withColumn("_place", place).join(F.broadcast(rows), "_place", "left").drop("_place")


def m_splines(order: int, n: int, size: int) -> np.ndarray:
    """(n, size): M-splines with evenly spaced knots on [0, 1), each of integral one; by the triangular scheme of B-splines."""
    if n < order:
        raise ValueError("order can't be larger than the number of basis functions")
    inner = np.linspace(0, 1, n - order + 2)
    knots = np.concatenate([np.zeros(order - 1), inner, np.ones(order - 1)])
    x = np.linspace(0, 1 - 1e-6, size)
    level = ((x >= knots[:-1, None]) & (x < knots[1:, None])).astype(float)
    share = lambda top, bottom: np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 1e-6)
    for k in range(2, order + 1):
        lo, hi = knots[: len(knots) - k], knots[k:]
        rise = share(x - lo[:, None], np.broadcast_to((knots[k - 1 : -1] - lo)[:, None], (len(lo), size)))
        fall = share(hi[:, None] - x, np.broadcast_to((hi - knots[1 : len(hi) + 1])[:, None], (len(hi), size)))
        level = rise * level[:-1] + fall * level[1:]
    return level * order / (knots[order:] - knots[: len(knots) - order])[:, None]


def multiphase(spark: SparkSession, size: int, periods: float = 1.0, waves: int = 3) -> DataFrame:
    """(wave, i, phase, value): cosines that share a period evenly."""
    turn = F.col("i") * (2 * np.pi * periods / max(size - 1, 1))
    grid = spark.range(size * waves).select(F.floor(F.col("id") / size).alias("wave"), F.pmod("id", F.lit(size)).alias("i"))
    phase = turn - F.col("wave") * (2 * np.pi / waves)
    return grid.withColumn("phase", phase).withColumn("value", F.cos("phase"))


def one_hot_of(label: Column, labels: Sequence[str]) -> Column:
    """An array of flags for the first letters, in upper case, of given labels; an unknown letter gives none."""
    first = F.upper(F.substring(label, 1, 1))
    return F.array(*(F.coalesce(first == x[:1].upper(), F.lit(False)) for x in labels))


def even_spline(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through evenly spaced values, its third derivative continuous at the second and last but one, at places counted in steps."""
    y, at, n = np.asarray(y, float), np.asarray(at, float), len(y)
    if n < 4:
        raise ValueError("a cubic spline needs four values")
    bend = np.zeros(n)  # second derivatives: b[i-1] + 4 b[i] + b[i+1] = d[i], and the second and last but one are d / 6
    d = 6 * (y[:-2] - 2 * y[1:-1] + y[2:])
    bend[1], bend[-2] = d[0] / 6, d[-1] / 6
    if n > 4:
        right = d[1:-1].copy()
        right[0] -= bend[1]
        right[-1] -= bend[-2]
        share = np.zeros(len(right))
        for i in range(len(right)):
            pivot = 4 - (share[i - 1] if i else 0)
            share[i] = 1 / pivot
            right[i] = (right[i] - (right[i - 1] if i else 0)) / pivot
        for i in range(len(right) - 2, -1, -1):
            right[i] -= share[i] * right[i + 1]
        bend[2:-2] = right
    bend[0], bend[-1] = 2 * bend[1] - bend[2], 2 * bend[-2] - bend[-3]
    k = np.clip(np.floor(at).astype(int), 0, n - 2)
    u = at - k
    v = 1 - u
    return v * y[k] + u * y[k + 1] + ((v**3 - v) * bend[k] + (u**3 - u) * bend[k + 1]) / 6


def scaled_waves(mother: np.ndarray, lengths: Sequence[int], windows: Sequence[int] | None = None, kind: str = "cubic", fill: float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(x, wave) of a mother wave stretched to each length and sampled over a window around its middle; ``fill`` outside. ``kind``: cubic, linear or nearest."""
    windows = lengths if windows is None else windows
    steps, out = len(mother) - 1, []
    for length, window in zip(lengths, windows, strict=True):
        x = (np.linspace(0, 1, window) - 0.5) * (window / length)
        at = (x + 0.5) * steps
        if kind == "cubic":
            wave = even_spline(mother, at)
        elif kind == "linear":
            wave = np.interp(at, np.arange(steps + 1), mother)
        elif kind == "nearest":
            wave = np.asarray(mother, float)[np.clip(np.ceil(at - 0.5).astype(int), 0, steps)]
        else:
            raise ValueError(f"unknown kind {kind!r}")
        out.append((x, np.where(np.abs(x) <= 0.5, wave, fill)))
    return out
