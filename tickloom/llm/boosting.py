"""Gradient-boosted trees for a two-class log loss, in NumPy: small, deterministic, trained on the driver on a bounded sample."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of a fixed depth over quantile-binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0
        self.scale, self.shift = 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def _raw(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b, inner = self._binned(x), 2**self.depth - 1
        width = self.bins + 1
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                gains = []
                for k in range(x.shape[1]):
                    cell = (node - first) * width + b[:, k]
                    gs = np.bincount(cell, g, 2**level * width).reshape(-1, width).cumsum(1)
                    hs = np.bincount(cell, h, 2**level * width).reshape(-1, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gains.append(gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2))
                gain = np.stack(gains)
                for n in range(2**level):
                    k, c = np.unravel_index(int(gain[:, n].argmax()), gain[:, n].shape)
                    if gain[k, n, c] > 1e-9:
                        feature[first + n], cut[first + n] = k, c
                node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
            leaf_of = node - inner
            leaf = self.rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + self.l2)
            self.trees.append((feature, cut, leaf))
            score += leaf[leaf_of]
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> BoostedTrees:
        """Platt scaling on rows that were not trained on."""
        raw, n = self._raw(self._binned(x)), len(y)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (n - y.sum() + 2))
        a, c = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * raw + c)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - target) * raw).sum(), (p - target).sum()])
            hess = np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            a, c = np.array([a, c]) - np.linalg.solve(hess, grad)
        self.scale, self.shift = float(a), float(c)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self._raw(self._binned(x)) + self.shift, -50, 50)))
