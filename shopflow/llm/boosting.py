"""Gradient-boosted trees over a histogram of small integer features.

The rows are feature cells with counts, so training sees every example at a size bounded by
the number of cells; a fitted model is a plain expression over columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray):
    """(gain, feature, value) of the best ``feature <= value``."""
    best = (1e-9, None, None)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        values = x[rows, f]
        top = int(values.max()) + 1
        gs = np.cumsum(np.bincount(values, g[rows], top))[:-1]
        hs = np.cumsum(np.bincount(values, h[rows], top))[:-1]
        if len(gs):
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    return best


def _grow(x, g, h, rows, depth):
    gain, f, v = _split(x, g, h, rows) if depth and len(rows) > 1 else (0, None, None)
    if f is None:
        return float(g[rows].sum() / (h[rows].sum() + 1))
    low = rows[x[rows, f] <= v]
    return f, v, _grow(x, g, h, low, depth - 1), _grow(x, g, h, rows[x[rows, f] > v], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, v, low, high = tree
    return np.where(x[:, f] <= v, _value(low, x), _value(high, x))


def fit(cells: np.ndarray, n: np.ndarray, positive: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.4) -> list:
    """Logistic boosting; ``cells`` (non-negative integers), counts and positive counts per cell."""
    score, trees = np.zeros(len(cells)), []
    for _ in range(rounds if len(cells) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(cells, positive - n * p, n * p * (1 - p), np.arange(len(cells)), depth)
        trees.append(tree)
        score += rate * _value(tree, cells)
    return [(rate, t) for t in trees]


def predict(model: list, cells: np.ndarray) -> np.ndarray:
    return sum((rate * _value(t, cells) for rate, t in model), np.zeros(len(cells)))


def calibrate(score: np.ndarray, n: np.ndarray, positive: np.ndarray, precision: float) -> float:
    """Lowest score that has this precision itself and for all examples from it upwards; infinity if none does.

    A score whose own examples are wrong is not let in on account of the right ones above it."""
    levels, at = np.unique(-score, return_inverse=True)
    own, all_ = np.bincount(at, positive, len(levels)), np.bincount(at, n, len(levels))
    good = np.flatnonzero((own >= precision * all_) & (np.cumsum(own) >= precision * np.cumsum(all_)))
    return float(-levels[good[-1]]) if len(good) else float("inf")


def as_column(model: list, features: list[Column]) -> Column:
    def one(tree):
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, v, low, high = tree
        return F.when(features[f] <= v, one(low)).otherwise(one(high))
    out = F.lit(0.0)
    for rate, tree in model:
        out = out + one(tree) * rate
    return out
