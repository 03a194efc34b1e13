"""Gradient-boosted trees in numpy: histogram training with monotonic constraints, flattened node arrays for scoring."""

from __future__ import annotations

import numpy as np


class Forest:
    """Complete binary trees of one depth, laid out flat: node i of a tree has the children 2i+1 and 2i+2."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature = np.zeros((0, (1 << depth) - 1), np.int32)
        self.threshold = np.zeros((0, (1 << depth) - 1))
        self.value = np.zeros((0, 1 << depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: int = 20) -> Forest:
    """Logistic loss. monotone[j] is +1 or -1 where the score may only rise or fall with feature j, else 0.

    Children of a split on a constrained feature are kept in order, and their midpoint bounds all that
    grows below them, so the whole forest is monotone. No rows, or one class only: a constant.
    """
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    forest = Forest(depth, float(np.log(mean / (1 - mean))))
    if len(y) < 2 * least or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), forest.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, np.inf)
        value = np.zeros(1 << depth)
        node = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for at in range((1 << depth) - 1):
            lo, hi = bounds.get(at, (-np.inf, np.inf))
            rows = np.flatnonzero(node == at)
            best = _split(binned[rows], g[rows], h[rows], cuts, monotone, lo, hi, l2, least) if len(rows) >= 2 * least else None
            left, right = 2 * at + 1, 2 * at + 2
            if best is None:
                bounds[left] = bounds[right] = (lo, hi)
                node[rows] = left  # the threshold stays infinite, so everything goes left
                continue
            j, b, wl, wr = best
            feature[at], threshold[at] = j, cuts[j][b]
            node[rows] = np.where(binned[rows, j] > b, right, left)
            middle = (wl + wr) / 2
            bounds[left], bounds[right] = ((lo, middle), (middle, hi)) if monotone[j] > 0 else ((middle, hi), (lo, middle)) if monotone[j] < 0 else ((lo, hi), (lo, hi))
        inner = (1 << depth) - 1
        for leaf in range(1 << depth):
            rows = node == inner + leaf
            if rows.any():
                value[leaf] = rate * np.clip(-g[rows].sum() / (h[rows].sum() + l2), *bounds[inner + leaf])
            else:
                value[leaf] = rate * np.clip(0.0, *bounds[inner + leaf])
        margin += value[node - inner]
        features.append(feature), thresholds.append(threshold), values.append(value)
    forest.feature, forest.threshold, forest.value = np.stack(features), np.stack(thresholds), np.stack(values)
    return forest


def _split(binned, g, h, cuts, monotone, lo, hi, l2, least):
    whole_g, whole_h, best, most = g.sum(), h.sum(), None, 1e-6
    before = whole_g**2 / (whole_h + l2)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        n = len(c) + 1
        gl = np.cumsum(np.bincount(binned[:, j], g, n))[:-1]
        hl = np.cumsum(np.bincount(binned[:, j], h, n))[:-1]
        nl = np.cumsum(np.bincount(binned[:, j], minlength=n))[:-1]
        wl = np.clip(-gl / (hl + l2), lo, hi)
        wr = np.clip(-(whole_g - gl) / (whole_h - hl + l2), lo, hi)
        ok = (nl >= least) & (len(g) - nl >= least) & (monotone[j] * (wr - wl) >= 0)
        # the loss that a leaf of weight w saves: -(g w + (h + l2) w^2 / 2), times 2
        gain = -(2 * gl * wl + (hl + l2) * wl**2) - (2 * (whole_g - gl) * wr + (whole_h - hl + l2) * wr**2) - before
        gain = np.where(ok, gain, -1)
        b = int(np.argmax(gain))
        if gain[b] > most:
            most, best = gain[b], (j, b, float(wl[b]), float(wr[b]))
    return best
