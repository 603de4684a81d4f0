"""A small CART classifier (Gini impurity) for a bounded labelled table."""

from __future__ import annotations

from collections.abc import Sequence

Node = tuple  # (label,) or (feature, threshold, left, right): left if value <= threshold


def _gini(labels: Sequence[int]) -> float:
    p = sum(labels) / len(labels)
    return 2 * p * (1 - p) * len(labels)


def fit(rows: list[list[float]], labels: list[int], depth: int = 8) -> Node:
    """The tree; among equal splits the first feature and the least threshold win, so a fit is reproducible."""
    if depth == 0 or len(set(labels)) == 1:
        return (int(2 * sum(labels) >= len(labels)),)
    best = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            left = [y for r, y in zip(rows, labels) if r[f] <= cut]
            right = [y for r, y in zip(rows, labels) if r[f] > cut]
            score = _gini(left) + _gini(right)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, cut)
    if best is None:
        return (int(2 * sum(labels) >= len(labels)),)
    _, f, cut = best
    left = [k for k, r in enumerate(rows) if r[f] <= cut]
    right = [k for k, r in enumerate(rows) if r[f] > cut]
    return (f, cut, *(fit([rows[k] for k in side], [labels[k] for k in side], depth - 1) for side in (left, right)))


def predict(tree: Node, row: Sequence[float]) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]
