"""Gradient-boosted trees for two classes on small feature tables, in numpy: logistic loss, depth-limited trees, shrinkage."""

from __future__ import annotations

import numpy as np


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: float) -> list:
    """A leaf [value] or a node [feature, cut, left, right]; the split gains most by the second-order criterion."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, 0.0)
    if depth:
        for f in range(x.shape[1]):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            gl, hl, v = np.cumsum(grad[rows][order])[:-1], np.cumsum(hess[rows][order])[:-1], v[order]
            ok = (v[1:] > v[:-1]) & (hl >= least) & (h - hl >= least)
            if ok.any():
                gain = np.where(ok, gl**2 / (hl + 1) + (g - gl)**2 / (h - hl + 1) - g**2 / (h + 1), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] < 0:
        return [float(-g / (h + 1))]
    left = x[rows, best[1]] <= best[2]
    return [best[1], best[2], _grow(x, grad, hess, rows[left], depth - 1, least), _grow(x, grad, hess, rows[~left], depth - 1, least)]


def _apply(node: list, x: np.ndarray) -> np.ndarray:
    if len(node) == 1:
        return np.full(len(x), node[0])
    left = x[:, node[0]] <= node[1]
    out = np.empty(len(x))
    out[left], out[~left] = _apply(node[2], x[left]), _apply(node[3], x[~left])
    return out


class BoostedTrees:
    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[list] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), self.depth, self.least)
            self.trees.append(tree)
            score += self.rate * _apply(tree, x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self.rate * _apply(tree, x)
        return 1 / (1 + np.exp(-score))
