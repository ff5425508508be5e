"""Gradient-boosted trees and isotonic calibration on a bounded numpy sample of dense features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS, L2, LEAST = 60, 3, 0.15, 64, 1.0, 8.0


@dataclass
class Trees:
    """Complete trees in heap order: inner nodes hold a feature and a limit, leaves a step."""

    base: float
    features: np.ndarray  # (trees, 2 ** depth - 1)
    limits: np.ndarray
    leaves: np.ndarray  # (trees, 2 ** depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.features.shape[1]
        for f, limit, leaf in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > limit[node])
            out += leaf[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order gains over quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1)
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(len(y), base)
    inner = 2 ** DEPTH - 1
    features, limits = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf)
    leaves = np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for k in range(2 ** level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                best = (1e-9, 0, np.inf)
                for f, c in enumerate(cuts):
                    if not len(c) or not len(own):
                        continue
                    hg = np.cumsum(np.bincount(binned[own, f], g[own], len(c) + 1))
                    hh = np.cumsum(np.bincount(binned[own, f], h[own], len(c) + 1))
                    n = np.cumsum(np.bincount(binned[own, f], minlength=len(c) + 1))
                    gain = hg ** 2 / (hh + L2) + (hg[-1] - hg) ** 2 / (hh[-1] - hh + L2) - hg[-1] ** 2 / (hh[-1] + L2)
                    gain = np.where((n >= LEAST) & (n[-1] - n >= LEAST), gain, 0)[:-1]
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], f, c[at])
                features[t, k], limits[t, k] = best[1], best[2]
                node[own] = 2 * k + 1 + (x[own, best[1]] > best[2])
        leaf = node - inner
        step = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        leaves[t] = step
        raw += step[leaf]
    return Trees(base, features, limits, leaves)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising function of ``raw`` that fits ``y``."""
    order = np.argsort(raw, kind="stable")
    values, first = np.unique(raw[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    counts = np.diff(np.append(first, len(raw))).astype(float)
    blocks: list[list[float]] = []
    for v, s, n in zip(values, sums, counts):
        blocks.append([v, v, s, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, high = blocks[-2], blocks.pop()
            low[1], low[2], low[3] = high[1], low[2] + high[2], low[3] + high[3]
    knots = np.array([k for b in blocks for k in b[:2]])
    return knots, np.repeat([b[2] / b[3] for b in blocks], 2)
