"""Search over parameters: every trial is a row, so trials run in parallel, each cross-validated on one bounded sample."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

#: Numbers of the sample that goes along with the trials.
MOST_NUMBERS = 8_000_000
Objective = Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[float, float]]


def drawn(space: dict[str, list | tuple], trial: int, seed: int) -> dict:
    """The trial's parameters: a list is a choice; ("int" | "uniform" | "log", low, high) a range, both ends included."""
    rng = np.random.default_rng([seed, trial])
    out = {}
    for name, what in space.items():
        if isinstance(what, list):
            out[name] = what[int(rng.integers(len(what)))]
        else:
            kind, low, high = what
            out[name] = int(rng.integers(low, high + 1)) if kind == "int" else float(rng.uniform(low, high)) if kind == "uniform" else float(np.exp(rng.uniform(np.log(low), np.log(high))))
    return out


def ridge(params: dict, x: np.ndarray, y: np.ndarray, x_test: np.ndarray, y_test: np.ndarray) -> tuple[float, float]:
    """Scaled squared errors on train and test rows of ridge regression with an intercept; parameter ``alpha``."""
    m, my = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + params["alpha"] * np.eye(x.shape[1]), (x - m).T @ (y - my))
    loss = lambda a, b: float((((a - m) @ w + my - b) ** 2).mean() / max(y.var(), 1e-300))
    return loss(x, y), loss(x_test, y_test)


def logistic(params: dict, x: np.ndarray, y: np.ndarray, x_test: np.ndarray, y_test: np.ndarray) -> tuple[float, float]:
    """Cross-entropies on train and test rows of ridge-penalised logistic regression; parameter ``alpha``."""
    m, s = x.mean(axis=0), x.std(axis=0)
    s = np.where(s > 0, s, 1)
    one = lambda a: np.column_stack([(a - m) / s, np.ones(len(a))])
    a, w = one(x), np.zeros(x.shape[1] + 1)
    penalty = np.diag([params["alpha"]] * x.shape[1] + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break

    def loss(rows: np.ndarray, truth: np.ndarray) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(one(rows) @ w, -40, 40))), 1e-12, 1 - 1e-12)
        return float(-np.log(np.where(truth == 1, p, 1 - p)).mean())

    return loss(x, y), loss(x_test, y_test)


@dataclass
class Found:
    """Every trial (trial, params, train, test, loss), and the best one's parameters and loss."""

    trials: pd.DataFrame
    params: dict
    loss: float


def search(df: DataFrame, features: Sequence[str], target: str, space: dict[str, list | tuple], objective: Objective, *, trials: int = 64, batch: int = 16, patience: int = 48, tol_frac: float = 0.01,
           folds: int = 3, group: Sequence[str] = (), penalty: float = 0.0, most_rows: int = 100_000, seed: int = 0) -> Found:
    """The parameters of the least mean test loss over hashed folds, times (test / train) ** penalty.

    Trials come in batches; the search ends early when the best loss moved by less than ``tol_frac`` of itself over the
    last ``patience`` trials. Rows with a missing value take no part; at most about ``most_rows`` of the others, by hash,
    are the sample, and a group is never split between folds.
    """
    names = [*features, target]
    rows = df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)), F.pmod(F.xxhash64(F.lit(seed), *(group or names)), F.lit(folds)).cast("double").alias("_fold"),
                     F.pmod(F.xxhash64(F.lit(seed + 1), *names), F.lit(1_000_000)).alias("_h"))
    for i in range(len(names)):
        rows = rows.where(F.col(f"_{i}").isNotNull() & ~F.isnan(f"_{i}"))
    most = min(most_rows, MOST_NUMBERS // (len(names) + 1))
    n = rows.count()
    picked = rows.where(F.col("_h") < min(1.0, most / max(n, 1)) * 1_000_000).drop("_h").limit(2 * most)
    held = picked.toPandas().to_numpy(float)
    held = held[np.lexsort(held.T)]
    shared = df.sparkSession.sparkContext.broadcast(held)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, fold = shared.value[:, : len(features)], shared.value[:, len(features)], shared.value[:, -1]
        for part in parts:
            out = []
            for t in part["trial"]:
                params, got = drawn(space, int(t), seed), []
                for k in range(folds):
                    inside = fold == k
                    if inside.any() and not inside.all():
                        got.append(objective(params, x[~inside], y[~inside], x[inside], y[inside]))
                train, test = np.mean(got, axis=0) if got else (np.nan, np.nan)
                out.append((int(t), json.dumps(params), train, test, test * (test / train) ** penalty if penalty else test))
            yield pd.DataFrame(out, columns=["trial", "params", "train", "test", "loss"])

    ship(df.sparkSession)
    done: list[pd.DataFrame] = []
    for first in range(0, trials, batch):
        last = min(first + batch, trials)
        asked = df.sparkSession.range(first, last, numPartitions=last - first).withColumnRenamed("id", "trial")
        done.append(asked.mapInPandas(run, "trial long, params string, train double, test double, loss double").toPandas())
        best = pd.concat(done).sort_values("trial")["loss"].cummin().to_numpy()
        if len(best) >= patience and best[-patience] - best[-1] <= tol_frac * abs(best[-1]):
            break
    table = pd.concat(done).sort_values("trial", ignore_index=True)
    top = table.loc[table["loss"].fillna(np.inf).idxmin()]
    return Found(table, json.loads(top["params"]), float(top["loss"]))


def tune_regression(df: DataFrame, features: Sequence[str], target: str, **more) -> Found:
    return search(df, features, target, {"alpha": ("log", 1e-4, 1e4)}, ridge, **more)


def tune_classifier(df: DataFrame, features: Sequence[str], target: str, **more) -> Found:
    return search(df, features, target, {"alpha": ("log", 1e-4, 1e4)}, logistic, **more)
