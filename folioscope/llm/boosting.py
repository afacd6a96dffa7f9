"""Gradient-boosted trees over a bounded training matrix, isotonic calibration, and both as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees are nested tuples (feature, threshold, if at most, else) with numbers as leaves; they add to ``base``."""

    base: float
    trees: list

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            self._add(t, x, np.arange(len(x)), out)
        return out

    def _add(self, tree, x, rows, out) -> None:
        if not isinstance(tree, tuple):
            out[rows] += tree
        elif len(rows):
            f, cut, low, high = tree
            left = x[rows, f] <= cut
            self._add(low, x, rows[left], out)
            self._add(high, x, rows[~left], out)

    def column(self, features: list):
        """The margin as a Spark column over feature columns."""
        from pyspark.sql import functions as F

        def one(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, cut, low, high = tree
            return F.when(features[f] <= F.lit(float(cut)), one(low)).otherwise(one(high))

        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + one(t)
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> Boosted:
    """Newton boosting of logistic loss with histograms of at most ``bins`` quantile bins a feature."""
    n, width = x.shape if x.ndim == 2 else (0, 0)
    share = min(max(float(y.mean()) if n else 0.0, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Boosted(base, [])
    cuts = []
    for f in range(width):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        q = np.unique(np.r_[q, np.unique(x[:, f])[:bins]]) if len(np.unique(x[:, f])) <= bins else q
        cuts.append(q[q < x[:, f].max()])
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, out = np.full(n, base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(-rate * gs / (hs + l2))
        if not level:
            return leaf
        best = (1e-6, 0, 0)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            own = binned[rows, f]
            gl = np.cumsum(np.bincount(own, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(own, h[rows], len(c) + 1))[:-1]
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            gain[(hl < least) | (hs - hl < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[0] <= 1e-6:
            return leaf
        _, f, k = best
        left = binned[rows, f] <= k
        return (f, float(cuts[f][k]), grow(rows[left], g, h, level - 1), grow(rows[~left], g, h, level - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(n), p - y, p * (1 - p), depth)
        out.append(tree)
        step = np.zeros(n)
        Boosted(0.0, [])._add(tree, x, np.arange(n), step)
        margin += step
    return Boosted(base, out)


@dataclass
class Isotonic:
    """A rising function: flat over each block of margins, with straight lines between blocks."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return 1 / (1 + np.exp(-margin))
        return np.interp(margin, self.at, self.value)


def isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 0.5) -> Isotonic:
    """Pool adjacent violators; each block counts ``prior`` rows of either class besides its own."""
    if not len(y):
        return Isotonic(np.zeros(0), np.zeros(0))
    kinds, where = np.unique(margin, return_inverse=True)
    hits, rows = np.bincount(where, y), np.bincount(where).astype(float)
    blocks: list[list[float]] = []  # rows of class 1, rows, lowest and highest margin
    for m, k, n in zip(kinds, hits, rows):
        blocks.append([k, n, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            k, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + k, blocks[-1][1] + n, blocks[-1][2], high]
    value = np.maximum.accumulate([(k + prior) / (n + 2 * prior) for k, n, _, _ in blocks])
    return Isotonic(np.array([m for b in blocks for m in b[2:]]), np.repeat(value, 2))
