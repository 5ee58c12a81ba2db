"""Small numpy models fitted on bounded samples: gradient-boosted trees, isotonic and logistic regression."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Gradient-boosted trees for log loss on binned features; every tree is a complete one of ``depth`` levels."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        binned = self._bin(x)
        raw = np.full(len(y), self.base)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width, inner = self.bins + 1, (1 << self.depth) - 1
        for _ in range(self.trees if len(y) else 0):
            p = sigmoid(raw)
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut, at = np.zeros(inner, int), np.full(inner, width), np.zeros(len(y), int)
            for level in range(self.depth):
                low, n = (1 << level) - 1, 1 << level
                best = np.full(n, 1e-9)
                for f in range(x.shape[1]):
                    key = (at - low) * width + binned[:, f]
                    sg = np.bincount(key, g, n * width).reshape(n, width).cumsum(axis=1)
                    sh = np.bincount(key, h, n * width).reshape(n, width).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.ridge) + (tg - sg) ** 2 / (th - sh + self.ridge) - tg**2 / (th + self.ridge)
                    gain[(sh < 1) | (th - sh < 1)] = 0
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(n), top] > best
                    best = np.where(better, gain[np.arange(n), top], best)
                    feature[low : low + n][better] = f
                    cut[low : low + n][better] = top[better]
                at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            self.nodes.append((feature, cut, value))
            raw += value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if x.shape[1] else np.zeros((len(x), 0), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out, inner = self._bin(x), np.full(len(x), self.base), (1 << self.depth) - 1
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out


class Isotonic:
    """Pool-adjacent-violators calibration, linear between the pools, kept within [0, 1]."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []
        for x, v in zip(raw[order], y[order], strict=True):
            pools.append([x, v, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                x1, v1, n1 = pools.pop()
                pools[-1] = [(pools[-1][0] * pools[-1][2] + x1 * n1) / (pools[-1][2] + n1), pools[-1][1] + v1, pools[-1][2] + n1]
        self.x = np.array([p[0] for p in pools]) if pools else np.zeros(1)
        self.y = np.array([p[1] / p[2] for p in pools]) if pools else np.zeros(1)
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0, 1)


def fit_calibrated(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **params) -> tuple[BoostedTrees, Isotonic]:
    """Trees on all rows, and the calibration of out-of-fold scores.

    ``x``: (row, k + 1, feature); of k folds, x[:, i] holds the features made without fold i, the last those made from all rows.
    """
    out = np.zeros(len(y))
    for i in range(x.shape[1] - 1):
        own = fold == i
        out[own] = BoostedTrees(**params).fit(x[~own, i], y[~own]).raw(x[own, i])
    return BoostedTrees(**params).fit(x[:, -1], y), Isotonic().fit(out, y)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) by damped Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w, weight = np.zeros(a.shape[1]), np.ones(len(y)) if weight is None else weight
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (weight * (y - p)) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w
