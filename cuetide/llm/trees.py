"""Small gradient-boosted trees on numpy, for bounded tables of weighted rows on the driver."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, depth-wise trees over quantile thresholds, Platt calibration."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.trees: list[list] = []
        self.base, self.scale, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, tune: np.ndarray) -> BoostedTrees:
        """``weight``: how many examples a row stands for; rows of ``tune`` are for the calibration."""
        a, b, w = x[~tune], y[~tune].astype(float), weight[~tune].astype(float)
        cuts = [np.unique(np.quantile(a[:, j], np.linspace(0.02, 0.98, 31), weights=w, method="inverted_cdf")) for j in range(a.shape[1])]
        share = min(max(float(np.average(b, weights=w)), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(b), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(a, w * (p - b), w * p * (1 - p), w, np.arange(len(b)), cuts, self.depth)
            self.trees.append(tree)
            score += self._walk(tree, a)
        self._calibrate(self.raw(x[tune]), y[tune].astype(float), weight[tune].astype(float))
        return self

    def _grow(self, x, g, h, w, rows, cuts, depth):
        total, weight, many = g[rows].sum(), h[rows].sum(), w[rows].sum()
        leaf = -self.rate * total / (weight + self.ridge)
        if not depth or many < 2 * self.least:
            return leaf
        best, own = None, total**2 / (weight + self.ridge)
        for j, places in enumerate(cuts):
            for t in places:
                left = rows[x[rows, j] <= t]
                if self.least <= w[left].sum() <= many - self.least:
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + self.ridge) + (total - gl) ** 2 / (weight - hl + self.ridge) - own
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = (gain, j, t)
        if best is None:
            return leaf
        _, j, t = best
        under = x[rows, j] <= t
        return (j, t, self._grow(x, g, h, w, rows[under], cuts, depth - 1), self._grow(x, g, h, w, rows[~under], cuts, depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, t, left, right = tree
        return np.where(x[:, j] <= t, self._walk(left, x), self._walk(right, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def _calibrate(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Platt's two parameters by gradient steps, with his softened targets."""
        share = weight / weight.sum()
        n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
        aim = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(500):
            p = 1 / (1 + np.exp(-(self.scale * raw + self.shift)))
            self.scale -= 0.05 * (share * (p - aim) * raw).sum()
            self.shift -= 0.05 * (share * (p - aim)).sum()

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))

    def threshold(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float:
        """The lowest probability from which on the kept candidates are as precise as asked."""
        p = self.probability(x)
        order = np.argsort(-p, kind="stable")
        right = np.cumsum((weight * y)[order]) / np.cumsum(weight[order])
        last = np.append(p[order][1:] != p[order][:-1], True)  # equal probabilities stand or fall together
        good = np.flatnonzero((right >= precision) & last)
        return float(p[order[good[-1]]]) if len(good) else 1.1
