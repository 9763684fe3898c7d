"""Gradient-boosted trees for a binary target: logistic loss, histogram splits, complete trees of fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.3, l2: float = 1.0, least_hessian: float = 2.0):
        self.trees, self.depth, self.bins, self.rate, self.l2, self.least = trees, depth, bins, rate, l2, least_hessian

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        offsets = binned + np.arange(width) * self.bins
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.threshold = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, leaves))
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        f = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                count = 2**level
                local = node - (count - 1)
                keys = (local[:, None] * (width * self.bins) + offsets).ravel()
                size = count * width * self.bins
                gs = np.bincount(keys, np.repeat(g, width), size).reshape(count, width, self.bins).cumsum(2)
                hs = np.bincount(keys, np.repeat(h, width), size).reshape(count, width, self.bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < self.least) | (ht - hs < self.least)] = -1
                for k in range(count):
                    j, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                    at = count - 1 + k
                    if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                        self.feature[t, at], self.threshold[t, at] = j, edges[j][b]
                at = node
                right = x[np.arange(n), self.feature[t, at]] > self.threshold[t, at]
                node = 2 * node + 1 + right
            leaf = node - inner
            gl, hl = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
            self.leaf[t] = -self.rate * gl / (hl + self.l2)
            f += self.leaf[t, leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            f += self.leaf[t, node - (2**self.depth - 1)]
        return f
