"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Trees of equal depth as complete binary trees: split feature, split bin, leaf values."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, split, leaf in zip(self.feature, self.split, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > split[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def _edges(values: np.ndarray) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) <= BINS:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 2.0) -> Trees:
    """Logistic loss, exact second-order leaf values, best binned split per node."""
    share = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4))
    inner, leaves = (1 << depth) - 1, 1 << depth
    model = Trees(
        [_edges(x[:, j]) for j in range(x.shape[1])],
        float(np.log(share / (1 - share))),
        np.zeros((trees, inner), np.int64),
        np.full((trees, inner), BINS + 1, np.int64),
        np.zeros((trees, leaves)),
    )
    bins = model.binned(x)
    raw = np.full(len(x), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                cell = (node - first) * (BINS + 1) + bins[:, j]
                g = np.bincount(cell, grad, width * (BINS + 1)).reshape(width, -1)
                h = np.bincount(cell, hess, width * (BINS + 1)).reshape(width, -1)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                model.feature[t, first : first + width][better] = j
                model.split[t, first : first + width][better] = at[better]
            node = 2 * node + 1 + (bins[np.arange(len(x)), model.feature[t, node]] > model.split[t, node])
        at = node - inner
        model.leaf[t] = -rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + ridge)
        raw += model.leaf[t, at]
    return model
