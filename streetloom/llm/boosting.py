"""Gradient-boosted trees for two classes, in numpy: logistic loss, histogram splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of one depth; a row goes right where its value is above the cut."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - (len(value) - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Trees grown level by level on the gradients of the logistic loss."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(width)]
    two = [j for j in range(width) if ((x[:, j] == 0) | (x[:, j] == 1)).all()]  # these need one sum, not a histogram
    for j in two:
        edges[j] = np.zeros(1)
    flags, many = x[:, two].T.copy(), [j for j in range(width) if j not in set(two)]
    binned = {j: np.searchsorted(edges[j], x[:, j], side="left") for j in many}
    mean = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin, rows = np.full(n, base), np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            slot = at - first
            sums_g, sums_h = np.bincount(slot, g, count), np.bincount(slot, h, count)
            gain = np.full(count, 1e-3)

            def split(left_g: np.ndarray, left_h: np.ndarray) -> np.ndarray:
                """What a cut gains, given the sums to its left."""
                shape = (count,) + (1,) * (left_g.ndim - 1)
                all_g, all_h = sums_g.reshape(shape), sums_h.reshape(shape)
                right_g, right_h = all_g - left_g, all_h - left_h
                score = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                return np.where((left_h < 1) | (right_h < 1), 0, score)

            spread = np.zeros((n, 2 * count))
            spread[rows, slot], spread[rows, count + slot] = g, h
            right = flags @ spread
            score = split((sums_g - right[:, :count]).T, (sums_h - right[:, count:]).T)
            for s in range(count):
                best = int(score[s].argmax()) if two else 0
                if two and score[s, best] > gain[s]:
                    gain[s], feature[t, first + s], cut[t, first + s] = score[s, best], two[best], 0.0
            for j in many:
                if not len(edges[j]):
                    continue
                key = slot * BINS + binned[j]
                left_g = np.bincount(key, g, count * BINS).reshape(count, BINS).cumsum(1)[:, : len(edges[j])]
                left_h = np.bincount(key, h, count * BINS).reshape(count, BINS).cumsum(1)[:, : len(edges[j])]
                score = split(left_g, left_h)
                best = score.argmax(1)
                for s in np.flatnonzero(score[np.arange(count), best] > gain):
                    gain[s], feature[t, first + s], cut[t, first + s] = score[s, best[s]], j, edges[j][best[s]]
            at = 2 * at + 1 + (x[rows, feature[t, at]] > cut[t, at])
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[t][leaf]
    return Trees(base, feature, cut, value)
