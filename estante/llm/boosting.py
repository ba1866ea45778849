"""Gradient-boosted trees for a yes/no decision: histogram splits, logistic loss, numpy only. Fitted on bounded samples on the driver."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.made = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            size = 2 ** (self.depth + 1) - 1
            feature, value, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
            rows = {0: np.arange(len(y))}
            for node in range(size):
                r = rows.pop(node, None)
                if r is None:
                    continue
                gs, hs = g[r].sum(), h[r].sum()
                leaf[node] = -self.rate * gs / (hs + 1)
                if 2 * node + 2 >= size or hs < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for f, q in enumerate(cuts):
                    if not len(q):
                        continue
                    n = len(q) + 1
                    gl = np.cumsum(np.bincount(b[r, f], g[r], n))[:-1]
                    hl = np.cumsum(np.bincount(b[r, f], h[r], n))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < self.least) | (hs - hl < self.least)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[1] >= 0:
                    feature[node], value[node] = best[1], cuts[best[1]][best[2]]
                    left = b[r, best[1]] <= best[2]
                    rows[2 * node + 1], rows[2 * node + 2] = r[left], r[~left]
            self.made.append((feature, value, leaf))
            score += self._tree(x, *self.made[-1])
        return self

    def _tree(self, x: np.ndarray, feature: np.ndarray, value: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > value[at]), at)
        return leaf[at]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._tree(x, *t) for t in self.made), np.zeros(len(x)))
