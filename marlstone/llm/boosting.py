"""Gradient-boosted trees with logistic loss over binned dense features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Additive trees; each is a complete tree of ``depth`` levels of (feature, cut)."""

    base: float = 0.0
    depth: int = 3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return total


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Newton boosting on histograms; a split needs a positive gain, else its right side stays empty."""
    n, d = x.shape
    share = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), depth)
    if not n or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1)
    margin = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            start, width = 2**level - 1, 2**level
            local = node - start
            best = np.full(width, 1e-6)
            where = np.full((width, 2), -1)
            for j in range(d):
                key = local * (BINS + 1) + binned[:, j]
                g = np.bincount(key, gradient, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                h = np.bincount(key, weight, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                left = g**2 / (h + ridge)
                right = (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge)
                gain = left + right - (g[:, -1:] ** 2) / (h[:, -1:] + ridge)
                gain = np.where((h > 0.5) & (h[:, -1:] - h > 0.5), gain, 0)[:, : len(cuts[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                where[better] = np.stack([np.full(width, j), k], 1)[better]
            for a in range(width):
                if where[a, 0] >= 0:
                    feature[start + a], cut[start + a] = where[a, 0], cuts[where[a, 0]][where[a, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf_of = node - inner
        g = np.bincount(leaf_of, gradient, inner + 1)
        h = np.bincount(leaf_of, weight, inner + 1)
        leaf = -rate * g / (h + ridge)
        model.trees.append((feature, cut, leaf))
        margin += leaf[leaf_of]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (knots, values) of a non-decreasing step curve."""
    level, place = np.unique(score, return_inverse=True)
    sums, counts = np.bincount(place, y, len(level)), np.bincount(place, minlength=len(level))
    blocks: list[list[float]] = []  # [sum, weight, lowest, highest], one a level of the score to begin with
    for s, v, w in zip(level.tolist(), sums.tolist(), counts.tolist()):
        blocks.append([v, float(w), s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, w2, _, high = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += w2
            blocks[-1][3] = high
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    values = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return knots, values
