"""Gradient-boosted trees for a yes or no: histograms of binned features, level by level."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0):
        self.rounds, self.depth, self.bins, self.rate, self.ridge, self.least = rounds, depth, bins, rate, ridge, least
        self.edges: list[np.ndarray] = []
        self.start = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        code = self.binned(x)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(code, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._leaf(tree, code)
        return self

    def _grow(self, code: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree of ``depth`` levels: feature and last bin of the left side of each inner node, and the leaves."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
        at = np.zeros(len(code), np.int64)
        for level in range(self.depth):
            nodes = 2**level
            here = at - (nodes - 1)
            gain_best = np.zeros(nodes)
            for j in range(code.shape[1]):
                key = here * self.bins + code[:, j]
                g = np.bincount(key, grad, nodes * self.bins).reshape(nodes, self.bins).cumsum(1)
                h = np.bincount(key, hess, nodes * self.bins).reshape(nodes, self.bins).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(h < self.least) | (ht - h < self.least)] = 0
                best = gain.argmax(1)
                value = gain[np.arange(nodes), best]
                better = np.flatnonzero(value > gain_best + 1e-9)
                gain_best[better] = value[better]
                feature[nodes - 1 + better], cut[nodes - 1 + better] = j, best[better]
            at = 2 * at + 1 + (code[np.arange(len(code)), feature[at]] > cut[at])
        leaf = at - inner
        value = -np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + self.ridge)
        return feature, cut, value * self.rate

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(code), np.int64), np.arange(len(code))
        for _ in range(self.depth):
            at = 2 * at + 1 + (code[rows, feature[at]] > cut[at])
        return value[at - (2**self.depth - 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        code = self.binned(x)
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self._leaf(tree, code)
        return out
