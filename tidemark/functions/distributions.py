"""Normal and Student distributions as column expressions on Arrow batches: Spark has neither."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z)."""
    return 0.5 * np.asarray(_erfc(np.asarray(z, float) / math.sqrt(2)), float)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The z with P(Z <= z) = p; infinite at 0 and 1."""
    inverse = NormalDist().inv_cdf
    one = lambda x: math.nan if not 0 <= x <= 1 else -math.inf if x == 0 else math.inf if x == 1 else inverse(x)
    return np.array([one(x) for x in np.ravel(p)]).reshape(np.shape(p))


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method, for x below (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / guard(1 + step * d), guard(1 + step / c)
            out = out * d * c
    return out


def student_tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(T > t) with ``dof`` degrees of freedom."""
    t, dof = np.broadcast_arrays(np.asarray(t, float), np.asarray(dof, float))
    a, b = dof / 2, np.full(t.shape, 0.5)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        x = dof / (dof + t * t)
        front = np.exp(np.asarray(_lgamma(a + b), float) - np.asarray(_lgamma(a), float) - np.asarray(_lgamma(b), float) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        near = np.where(low, front * _beta_fraction(np.where(low, x, 0.1), a, b) / a, 1 - front * _beta_fraction(np.where(low, 0.1, 1 - x), b, a) / b)
    near = np.where(t == 0, 1.0, np.where(np.isinf(t), 0.0, near))
    return np.where(np.isnan(t) | ~(dof > 0), np.nan, np.where(t > 0, near / 2, 1 - near / 2))


def student_quantile(p: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """The t with P(T <= t) = p, by bisection."""
    p, dof = np.broadcast_arrays(np.asarray(p, float), np.asarray(dof, float))
    low, high = np.full(p.shape, -1e8), np.full(p.shape, 1e8)
    for _ in range(120):
        middle = (low + high) / 2
        above = 1 - student_tail(middle, dof) < p
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return np.where(dof > 0, (low + high) / 2, np.nan)


def _column(f):
    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        values = [pd.to_numeric(c).to_numpy(float, na_value=np.nan) for c in columns]
        return pd.Series(np.where(np.any(np.isnan(values), axis=0), np.nan, f(*values))).replace({np.nan: None}).astype("float64")

    return run


def p_of_z(z: Column, two_tailed: bool = True) -> Column:
    """The p-value of a z-score; of its size where one-tailed."""
    tails = 2 if two_tailed else 1
    return _column(lambda x: tails * normal_tail(np.abs(x)))(z.cast("double"))


def z_of_p(p: Column, two_tailed: bool = True) -> Column:
    return _column(lambda x: normal_quantile(1 - (x / 2 if two_tailed else x)))(p.cast("double"))


def p_of_t(t: Column, dof: Column, tail: str = "two") -> Column:
    """tail: two, greater or less."""
    tails = {"two": lambda x, n: 2 * student_tail(np.abs(x), n), "greater": student_tail, "less": lambda x, n: student_tail(-x, n)}
    return _column(tails[tail])(t.cast("double"), dof.cast("double"))


def t_of_p(p: float, dof: Column) -> Column:
    """The p-quantile of Student's distribution."""
    return _column(lambda n: student_quantile(p, n))(dof.cast("double"))
