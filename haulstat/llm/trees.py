"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""
from __future__ import annotations

import numpy as np

from .linear import sigmoid


class FlatTrees:
    """All trees in five parallel arrays; scoring walks every row through every tree level by level."""

    def __init__(self, base, roots, feature, threshold, left, right, value, depth):
        self.base, self.depth = base, depth
        self.roots = np.array(roots, np.int32)
        self.feature, self.left, self.right = (np.array(a, np.int32) for a in (feature, left, right))
        self.threshold, self.value = np.array(threshold, float), np.array(value, float)

    def probability(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[row, self.feature[node]] > self.threshold[node]
            node = np.where(right, self.right[node], self.left[node])  # a leaf points to itself
        return sigmoid(self.base + self.value[node].sum(axis=1))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15,
              bins: int = 48, l2: float = 2.0, least: int = 15) -> FlatTrees:
    """Boosted logistic trees. ``monotone[j]`` is -1, 0 or 1.

    A split against a feature's direction is refused, and a split on such a
    feature bounds the values of both sides by their middle, so the whole
    model is monotonic in it.
    """
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        at = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(at), right.append(at), value.append(v)
        return at

    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(monotone))]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    score = np.full(len(y), base)

    def grow(rows, grad, hess, low, high, level) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        own = float(np.clip(-g / (h + l2), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                b = binned[j][rows]
                gs, hs = (np.cumsum(np.bincount(b, w[rows], minlength=len(cuts) + 1))[:-1] for w in (grad, hess))
                ns = np.cumsum(np.bincount(b, minlength=len(cuts) + 1))[:-1]
                lv, rv = np.clip(-gs / (hs + l2), low, high), np.clip(-(g - gs) / (h - hs + l2), low, high)
                gain = -(gs * lv + 0.5 * (hs + l2) * lv ** 2) - ((g - gs) * rv + 0.5 * (h - hs + l2) * rv ** 2) + g * own + 0.5 * (h + l2) * own ** 2
                fine = (ns >= least) & (len(rows) - ns >= least) & ((rv - lv) * monotone[j] >= 0)
                gain = np.where(fine, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, lv[k], rv[k]))
        at = leaf(own * rate)
        if best[1] is not None:
            j, k, lv, rv = best[1]
            middle = (lv + rv) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
            goes = binned[j][rows] > k
            feature[at], threshold[at] = j, float(edges[j][k])
            left[at] = grow(rows[~goes], grad, hess, *bounds[0], level + 1)
            right[at] = grow(rows[goes], grad, hess, *bounds[1], level + 1)
        return at

    model = FlatTrees(base, roots, feature, threshold, left, right, value, depth)
    for _ in range(trees if len(y) else 0):
        p = sigmoid(score)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0))
        one = FlatTrees(0.0, roots[-1:], feature, threshold, left, right, value, depth)
        node = np.full(len(y), roots[-1])
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), one.feature[node]] > one.threshold[node], one.right[node], one.left[node])
        score = score + one.value[node]
    model = FlatTrees(base, roots, feature, threshold, left, right, value, depth)
    return model
