"""Gradient-boosted trees for a bounded table of training rows, and their evaluation on arrays."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth: arrays of split features, thresholds and leaf values, and a starting value."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.threshold, self.leaf = start, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 140, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0, share: float = 0.4, seed: int = 5) -> BoostedTrees:
    """Fit logistic loss level by level over quantile bins, with second-order leaf values; each tree sees a seeded share of rows."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)])
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, start)
    features, thresholds, leaves = [], [], []
    inner = 2**depth - 1
    for _ in range(trees):
        some = np.flatnonzero(rng.random(n) < share)
        p = 1 / (1 + np.exp(-margin[some]))
        g, h, part = y[some] - p, p * (1 - p), binned[:, some]
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(some), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = (at - first) * bins + part[j]
                gs = np.bincount(key, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hs = np.bincount(key, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(edges[j])]
                k = gain.argmax(1)
                value = gain[np.arange(nodes), k]
                better = value > best
                best[better] = value[better]
                feature[first : first + nodes][better] = j
                threshold[first : first + nodes][better] = edges[j][k[better]]
            at = 2 * at + 1 + (x[some, feature[at]] > threshold[at])
        leaf = rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + ridge)
        margin += BoostedTrees(0.0, feature[None], threshold[None], leaf[None]).margin(x)
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return BoostedTrees(start, np.array(features), np.array(thresholds), np.array(leaves))
