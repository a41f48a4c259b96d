"""Small gradient-boosted trees on binned features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Depth-wise trees under logistic loss; nodes of a tree in heap order."""

    edges: list[np.ndarray]
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: float = 2.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    # a feature that is mostly zero still gets a cut above zero
    edges = [np.unique(np.append(e, 0.0)) for e in edges]
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(prior / (1 - prior))))
    bins = model.binned(x)
    n, width = x.shape[1], max(len(e) for e in edges) + 1
    margin = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            start, count = 2**level - 1, 2**level
            local = node - start
            best = np.full(count, 1e-9)
            for j in range(n):
                key = local * width + bins[:, j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
                at = gain.argmax(axis=1)
                here = gain[np.arange(count), at]
                better = here > best
                best[better] = here[better]
                feature[start : start + count][better] = j
                cut[start : start + count][better] = at[better]
            node = 2 * node + 1 + (bins[np.arange(len(x)), feature[node]] > cut[node])
        local = node - (2**depth - 1)
        leaf = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + 1)
        margin += leaf[local]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve nearest to y (pool adjacent violators),
    to be interpolated between; rates are smoothed by half a row of each class."""
    order = np.argsort(score, kind="stable")
    values: list[list[float]] = []  # sum of y, weight, sum of scores
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        values.append([t, 1.0, s])
        while len(values) > 1 and values[-2][0] * values[-1][1] >= values[-1][0] * values[-2][1]:
            top = values.pop()
            values[-1] = [a + b for a, b in zip(values[-1], top, strict=True)]
    xs = np.array([v[2] / v[1] for v in values])
    ys = np.array([(v[0] + 0.5 * y.mean()) / (v[1] + 0.5) for v in values])
    return xs, np.maximum.accumulate(ys)
