"""Gradient-boosted trees for a bounded table, logistic loss, exact splits; evaluated as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (value,) or (feature, threshold, left, right): left if value <= threshold


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Tree, ...]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((np.array([_leaf(t, row) for row in x]) for t in self.trees), np.zeros(len(x)))

    def margin(self, features: list[Column]) -> Column:
        """The same sum as a DataFrame expression over the feature columns."""
        total = F.lit(self.start)
        for t in self.trees:
            total = total + _expression(t, features)
        return total


def _leaf(tree: Tree, row: np.ndarray) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def _expression(tree: Tree, features: list[Column]) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    return F.when(features[tree[0]] <= F.lit(tree[1]), _expression(tree[2], features)).otherwise(_expression(tree[3], features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float) -> Tree:
    value = (float(rate * g.sum() / (h.sum() + ridge)),)
    if depth == 0 or len(g) < 6:
        return value
    best, whole = (1e-6, -1, 0.0), g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gl, hl = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole
        gain[v[1:] == v[:-1]] = -1
        if len(gain) and gain.max() > best[0] + 1e-9:
            k = int(gain.argmax())
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] < 0:
        return value
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1, rate, ridge), _grow(x[~left], g[~left], h[~left], depth - 1, rate, ridge))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
    rate0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(rate0 / (1 - rate0)))
    f, grown = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        t = _grow(x, y - p, p * (1 - p), depth, rate, ridge)
        grown.append(t)
        f = f + np.array([_leaf(t, row) for row in x])
    return Boosted(start, tuple(grown))


def calibrated_threshold(margins: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin from which at least this share of held-out rows is positive; infinite if there is none."""
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(y[order])
    share = hits / np.arange(1, len(y) + 1)
    last_of_value = np.append(m[1:] != m[:-1], True)
    good = np.nonzero((share >= precision) & last_of_value)[0]
    if not len(good):
        return float("inf")
    k = int(good[-1])
    return float((m[k] + m[k + 1]) / 2) if k + 1 < len(m) else float(m[k])
