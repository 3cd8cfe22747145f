"""Gradient-boosted trees for two classes on small feature tables, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on binned features with logistic loss; fitted once, then only arrays."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: float = 3.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score, self.forest = np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree, leaf_of = self._grow(b, y - p, p * (1 - p))
            self.forest.append(tree)
            score += tree[2][leaf_of]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        """A full tree: for inner node i a feature and a bin (greater goes right), and the leaves' values."""
        inner = (1 << self.depth) - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, self.bins), np.zeros(len(g), int)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            best, gr, hr = 1e-9, g[rows], h[rows]
            whole = gr.sum() ** 2 / (hr.sum() + 1)
            for f in range(b.shape[1]) if len(rows) else ():
                gs, hs = (np.cumsum(np.bincount(b[rows, f], w, self.bins)) for w in (gr, hr))
                gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
                gain[(hs < self.leaf / 4) | (hs[-1] - hs < self.leaf / 4)] = 0
                if gain.max() > best:
                    best, feature[i], cut[i] = gain.max(), f, int(gain.argmax())
            node[rows] = 2 * i + 1 + (b[rows, feature[i]] > cut[i])
        leaf_of = node - inner
        n = inner + 1
        value = self.rate * np.bincount(leaf_of, g, n) / (np.bincount(leaf_of, h, n) + 1)
        return (feature, cut, value), leaf_of

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, score, row = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.forest:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[row, feature[node]] > cut[node])
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-score))
