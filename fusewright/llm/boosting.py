"""Gradient-boosted trees over dense features, with isotonic calibration; fitted on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising function of score: pooled adjacent violators."""
    order = np.argsort(scores, kind="stable")
    x, y = scores[order], labels[order].astype(float)
    x, first = np.unique(x, return_index=True)
    weight = np.diff(np.append(first, len(y))).astype(float)
    means = np.add.reduceat(y, first) / weight
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for m, w, v in zip(means, weight, x):
        blocks.append([m, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, start, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, start, last])
    knots_x = np.array([v for b in blocks for v in (b[2], b[3])])
    knots_y = np.array([b[0] for b in blocks for _ in (0, 1)])
    return knots_x, knots_y


@dataclass
class Boosted:
    """Trees of one depth as flat arrays: features and cuts by node, values by leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = (self.value.shape[1] - 1).bit_length()
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (len(v) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if self.knots is None:
            return 1 / (1 + np.exp(-m))
        return np.clip(np.interp(m, *self.knots), 0.0, 1.0)


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float, rate: float) -> tuple:
    """One tree level by level from histograms of 64 bins."""
    n, k = binned.shape
    bins = 64
    feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    node = np.zeros(n, np.int64)
    for level in range(depth):
        start, width = 2**level - 1, 2**level
        local = node - start
        best = np.zeros(width)
        pick = [(0, bins)] * width
        sums = np.bincount(local, g, width), np.bincount(local, h, width)
        parent = sums[0] ** 2 / (sums[1] + ridge)
        for f in range(k):
            if not len(cuts[f]):
                continue
            at = local * bins + binned[:, f]
            gl = np.cumsum(np.bincount(at, g, width * bins).reshape(width, bins), 1)
            hl = np.cumsum(np.bincount(at, h, width * bins).reshape(width, bins), 1)
            gr, hr = sums[0][:, None] - gl, sums[1][:, None] - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - parent[:, None]
            gain[(hl < least) | (hr < least)] = -1
            gain[:, len(cuts[f]) :] = -1
            top = gain.argmax(1)
            for i in np.flatnonzero(gain[np.arange(width), top] > best + 1e-9).tolist():
                best[i], pick[i] = gain[i, top[i]], (f, int(top[i]))
        for i, (f, b) in enumerate(pick):
            if best[i] > 0:
                feature[start + i], cut[start + i] = f, cuts[f][b]
        fs = np.array([p[0] for p in pick])[local]
        bs = np.array([p[1] if best[i] > 0 else bins for i, p in enumerate(pick)])[local]
        node = 2 * node + 1 + (binned[np.arange(n), fs] > bs)
    leaf = node - (2**depth - 1)
    value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
    return feature, cut, value, value[leaf]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 2.0, least: float = 2.0, calibrate: float = 0.25) -> Boosted:
    """Logistic boosting. The last rows, a share of calibrate, fit the isotonic calibration and no tree."""
    if not len(x) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        flat = np.zeros((0, 2**depth - 1))
        return Boosted(flat.astype(np.int64), flat, np.zeros((0, 2**depth)), 0.0, (np.array([0.0]), np.array([share])))
    held = int(len(x) * calibrate)
    a, b = x[: len(x) - held], y[: len(x) - held].astype(float)
    if b.min() == b.max() or held < 20:
        a, b, held = x, y.astype(float), 0
    cuts, binned = [], np.zeros(a.shape, np.int64)
    for f in range(a.shape[1]):
        values = np.unique(a[:, f])
        edges = (values[1:] + values[:-1]) / 2
        if len(edges) > 62:
            edges = np.unique(np.quantile(a[:, f], np.linspace(0, 1, 64)[1:-1]))
        cuts.append(edges)
        binned[:, f] = np.searchsorted(edges, a[:, f], "left")
    share = min(max(b.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(a), base)
    parts = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        *tree, step = _grow(binned, cuts, p - b, np.maximum(p * (1 - p), 1e-9), depth, ridge, least, rate)
        margin += step
        parts.append(tree)
    out = Boosted(*(np.array(c) for c in zip(*parts)), base)
    out.knots = isotonic(out.margin(x[len(x) - held :] if held else x), y[len(x) - held :] if held else y)
    return out
