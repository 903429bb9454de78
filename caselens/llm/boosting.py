"""Gradient-boosted trees for two classes on binned features, for samples of bounded size."""

from __future__ import annotations

import numpy as np

BINS, DEPTH, ROUNDS, RATE, LEAST = 32, 3, 60, 0.2, 8


class Trees:
    """Full binary trees of ``DEPTH`` levels: a feature and a cut per inner node, a value per leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        binned = self._binned(x)
        score = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._leaf(tree, binned)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, curvature: np.ndarray):
        features, cuts = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        node = np.zeros(len(binned), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            best = np.full(2**level, 1e-6)
            for f in range(binned.shape[1]):
                cell = (node - first) * BINS + binned[:, f]
                shape = (2**level, BINS)
                g = np.bincount(cell, gradient, 2**level * BINS).reshape(shape).cumsum(axis=1)
                h = np.bincount(cell, curvature, 2**level * BINS).reshape(shape).cumsum(axis=1)
                n = np.bincount(cell, minlength=2**level * BINS).reshape(shape).cumsum(axis=1)
                all_g, all_h, all_n = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                gain[(n < LEAST) | (all_n - n < LEAST)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(2**level), at]
                better = value > best
                best[better] = value[better]
                features[first : first + 2**level][better] = f
                cuts[first : first + 2**level][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(binned)), features[node]] > cuts[node])
        leaf = node - (2**DEPTH - 1)
        g, h = np.bincount(leaf, gradient, 2**DEPTH), np.bincount(leaf, curvature, 2**DEPTH)
        return features, cuts, RATE * g / (h + 1)

    @staticmethod
    def _leaf(tree, binned: np.ndarray) -> np.ndarray:
        features, cuts, values = tree
        node = np.zeros(len(binned), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[np.arange(len(binned)), features[node]] > cuts[node])
        return values[node - (2**DEPTH - 1)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        score = self.base + sum(self._leaf(t, binned) for t in self.trees)
        return 1 / (1 + np.exp(-score))


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float, least: int = 50) -> float:
    """The lowest probability from which at least ``precision`` of held-out rows are true, with
    ``least`` of them; above 1 where there is none."""
    order = np.argsort(-p, kind="stable")
    p, right = p[order], np.cumsum(y[order])
    n = np.arange(1, len(p) + 1)
    last = np.append(p[1:] != p[:-1], True)  # rows of equal probability are selected together
    good = np.flatnonzero((right >= precision * n) & (n >= least) & last)
    return float(p[good[-1]]) if len(good) else 2.0
