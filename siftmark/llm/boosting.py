"""Gradient-boosted trees in numpy: logistic loss, histogram splits, depth-limited complete trees."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """A binary classifier; trees are complete, node k has children 2k+1 and 2k+2."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1)  # bin b: x <= edges[b]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.leaf = np.zeros((self.rounds, inner + 1))
        score = np.full(n, self.bias)
        flat = binned + np.arange(m) * self.bins
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p) + 1e-9
            node = np.zeros(n, np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                if len(rows) < 2:
                    node[rows] = 2 * k + 1
                    continue
                at = flat[rows].ravel()
                gs = np.cumsum(np.bincount(at, np.repeat(g[rows], m), m * self.bins).reshape(m, -1), 1)
                hs = np.cumsum(np.bincount(at, np.repeat(h[rows], m), m * self.bins).reshape(m, -1), 1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < self.least * 0.05) | (ht - hs < self.least * 0.05)] = -np.inf
                for j in range(m):
                    gain[j, len(edges[j]) :] = -np.inf
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > 1e-6:
                    self.feature[t, k], self.cut[t, k] = j, edges[j][b]
                    node[rows] = 2 * k + 1 + (binned[rows, j] > b)
                else:
                    node[rows] = 2 * k + 1
            at = node - inner
            gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
            self.leaf[t] = -self.rate * gs / (hs + self.l2)
            score += self.leaf[t][at]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out
