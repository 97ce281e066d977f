"""Gradient-boosted regression trees for two classes, over binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Trees of equal depth as arrays: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner] if len(node) else 0
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 2.0) -> Trees:
    """Trees grown level by level: each node takes the split with the largest second-order gain."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    n, width = x.shape
    inner = 2**depth - 1
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    odds = np.full(n, start)
    features, thresholds, values = (np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, float), (inner + 1, float)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = node - first
            best = np.full(many, 1e-6)
            choice = np.zeros((many, 2), np.int64) + [0, BINS]
            for f in range(width):
                key = at * BINS + binned[:, f]
                gs = np.cumsum(np.bincount(key, g, many * BINS).reshape(many, BINS), 1)
                hs = np.cumsum(np.bincount(key, h, many * BINS).reshape(many, BINS), 1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                gain[:, len(cuts[f]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best
                best = np.where(better, gain[np.arange(many), top], best)
                choice[better] = np.stack([np.full(many, f), top], 1)[better]
            for k, (f, b) in enumerate(choice.tolist()):
                features[t, first + k] = f
                thresholds[t, first + k] = cuts[f][b] if b < len(cuts[f]) else np.inf
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        odds += values[t][leaf]
    return Trees(features, thresholds, values, start)
