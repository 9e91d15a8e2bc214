"""Gradient-boosted trees for a 0/1 label on a bounded training set, in numpy; used by two operators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Trees:
    """Full binary trees of one depth: node i has children 2i+1 and 2i+2; rows above the threshold go right."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return sigmoid(total)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32,
          ridge: float = 1.0, least: float = 1.0, times: np.ndarray | None = None) -> Trees:
    """Trees that follow the gradient of the logistic loss, split on quantile bins by second-order gain.

    With ``times``, each row stands for so many, and every value of a feature is a bin.
    Without rows, or with one class only, the probability is the smoothed share of ones.
    """
    counted = np.ones(len(y)) if times is None else times.astype(float)
    share = ((y * counted).sum() + 1) / (counted.sum() + 2)
    inner, base = 2 ** depth - 1, float(np.log(share / (1 - share)))
    features, thresholds, values = [], [], []
    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if times is None else np.unique(x[:, j])[:-1]
                for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        score = np.full(len(y), base)
        for _ in range(trees):
            p = sigmoid(score)
            gradient, curve = (y - p) * counted, p * (1 - p) * counted
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = 2 ** level - 1, 2 ** level
                best = np.zeros(width)
                chosen = [(0, None)] * width
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    slot = (node - first) * (len(c) + 1) + binned[:, j]
                    g = np.bincount(slot, gradient, width * (len(c) + 1)).reshape(width, -1)
                    h = np.bincount(slot, curve, width * (len(c) + 1)).reshape(width, -1)
                    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                    all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                    right_g, right_h = all_g - left_g, all_h - left_h
                    gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - all_g ** 2 / (all_h + ridge)
                    gain[(left_h < least) | (right_h < least)] = 0
                    at = gain.argmax(1)
                    for n in range(width):
                        if gain[n, at[n]] > best[n] + 1e-9:
                            best[n], chosen[n] = gain[n, at[n]], (j, at[n])
                for n, (j, cut) in enumerate(chosen):
                    if cut is not None:
                        feature[first + n], threshold[first + n] = j, cuts[j][cut]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
            leaf = node - inner
            g = np.bincount(leaf, gradient, inner + 1)
            h = np.bincount(leaf, curve, inner + 1)
            value = rate * g / (h + ridge)
            score += value[leaf]
            features.append(feature)
            thresholds.append(threshold)
            values.append(value)
    return Trees(base, np.array(features, np.int64).reshape(-1, inner), np.array(thresholds).reshape(-1, inner),
                 np.array(values).reshape(-1, inner + 1))
