"""A small logistic model over sparse rows, fitted on a bounded sample."""
from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


class SparseRows:
    """Rows of (indices, values), laid end to end."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(rows), width
        lengths = [len(i) for i, _ in rows]
        self.row = np.repeat(np.arange(self.n), lengths)
        self.index = np.concatenate([i for i, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.zeros(0)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], minlength=self.n)

    def transposed_dot(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * residual[self.row], minlength=self.width)


def fit_logistic(x: SparseRows, y: np.ndarray, l2: float, steps: int = 400, rate: float = 0.1, pairs: tuple[SparseRows, SparseRows] | None = None,
                 pair_weight: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam; no randomness, so a refit gives the same model.

    ``pairs`` are rows and their counterparts: the squared difference of their
    scores is added to the loss with ``pair_weight``.
    """
    weights, bias = np.zeros(x.width), 0.0
    if x.n == 0:
        return weights, -1.0
    first, second = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for step in range(1, steps + 1):
        residual = (sigmoid(x.dot(weights) + bias) - y) / x.n
        grad = x.transposed_dot(residual) + l2 * weights
        if pairs is not None and pairs[0].n:
            gap = 2.0 * pair_weight * (pairs[0].dot(weights) - pairs[1].dot(weights)) / pairs[0].n
            grad += pairs[0].transposed_dot(gap) - pairs[1].transposed_dot(gap)
        grad = np.append(grad, residual.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias
