"""Small gradient-boosted trees for binary targets, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting; a tree is arrays of features, cuts and leaf values by heap position."""

    def __init__(self, depth: int = 3, rounds: int = 40, rate: float = 0.3, cuts: int = 16, least: float = 2.0) -> None:
        self.depth, self.rounds, self.rate, self.cuts, self.least = depth, rounds, rate, cuts, least
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1])) for j in range(x.shape[1])]
        total = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            tree = self._grow(x, y - p, p * (1 - p), edges)
            self.trees.append(tree)
            total += self._value(tree, x)
        return self

    def _grow(self, x, slope, curve, edges):
        inner, leaves = 2**self.depth - 1, 2**self.depth
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(len(x), int)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            if len(own):
                g, h, best = slope[own], curve[own], 1e-6
                whole = g.sum() ** 2 / (h.sum() + 1)
                for j, points in enumerate(edges):
                    for c in points:
                        left = x[own, j] <= c
                        hl = h[left].sum()
                        hr = h.sum() - hl
                        if min(hl, hr) * 4 < self.least:
                            continue
                        gl = g[left].sum()
                        gain = gl * gl / (hl + 1) + (g.sum() - gl) ** 2 / (hr + 1) - whole
                        if gain > best:
                            best, feature[node], cut[node] = gain, j, c
                at[own] = 2 * node + 1 + (x[own, feature[node]] > cut[node])
        value = np.zeros(leaves)
        for k in range(leaves):
            own = at == inner + k
            value[k] = self.rate * slope[own].sum() / (curve[own].sum() + 1)
        return feature, cut, value

    def _value(self, tree, x):
        feature, cut, value = tree
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        return value[at - len(cut)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += self._value(tree, x)
        return 1 / (1 + np.exp(-total))


def precise_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on the share of positives is at least ``precision`` at
    every higher cut as well; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    fine = np.logical_and.accumulate(share >= precision)
    last = np.flatnonzero(fine & np.r_[p[order][1:] != p[order][:-1], True])
    return float(p[order][last[-1]]) if len(last) else 1.1
