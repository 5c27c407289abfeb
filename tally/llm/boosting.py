"""Gradient-boosted trees on the logistic loss, in numpy, with monotonic constraints.

Features are cut at quantiles; each tree grows level by level from histograms. A split
on a constrained feature counts only if its child values stand in the asked order, and
children inherit the bounds that the middle of the two values sets, so the sum of all
trees is monotonic. Trees are kept as flat node arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Node arrays of all trees: node i sends a row to left[i] if x[feature[i]] <= threshold[i], else to left[i] + 1; leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row of x."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                at = np.where(inner, self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at]), at)
            total += self.value[at]
        return total


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: int = 5) -> Forest:
    """monotone: -1, 0 or 1 for each feature. One class only, or no rows: a constant forest."""
    n = len(y)
    mean = float(np.clip((y.sum() + 1) / (n + 2), 1e-4, 1 - 1e-4))
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        total = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, p * (1 - p)
            roots.append(len(feature))
            for column in (feature, threshold, left, value):
                column.append(0)
            level = [(roots[-1], np.arange(n), -np.inf, np.inf)]
            for d in range(depth + 1):
                following = []
                for node, rows, low, high in level:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    own = float(np.clip(g / (h + ridge), low, high))
                    feature[node], value[node] = -1, own * rate
                    total[rows] = total[rows] if d < depth else total[rows] + own * rate
                    split = _best(binned[rows], grad[rows], hess[rows], cuts, monotone, low, high, ridge, least) if d < depth else None
                    if split is None:
                        if d < depth:
                            total[rows] += own * rate
                        continue
                    j, cut, a, b = split
                    feature[node], threshold[node], left[node] = j, cuts[j][cut], len(feature)
                    for column in (feature, threshold, left, value):
                        column.extend((0, 0))
                    middle = (a + b) / 2
                    bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(monotone[j]), ((low, high), (low, high)))
                    goes_left = binned[rows, j] <= cut
                    following += [(left[node], rows[goes_left], *bounds[0]), (left[node] + 1, rows[~goes_left], *bounds[1])]
                level = following
    as_array = lambda v, kind: np.array(v, dtype=kind)
    return Forest(as_array(feature, np.int32), as_array(threshold, float), as_array(left, np.int32), as_array(value, float), as_array(roots, np.int32), depth, base)


def _best(binned, grad, hess, cuts, monotone, low, high, ridge, least):
    """(feature, cut, left value, right value) of the best allowed split, or None."""
    g, h, n = grad.sum(), hess.sum(), len(grad)
    best, found = g * g / (h + ridge) + 1e-6, None
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        size = len(c) + 1
        gl = np.cumsum(np.bincount(binned[:, j], grad, size))[:-1]
        hl = np.cumsum(np.bincount(binned[:, j], hess, size))[:-1]
        nl = np.cumsum(np.bincount(binned[:, j], minlength=size))[:-1]
        a = np.clip(gl / (hl + ridge), low, high)
        b = np.clip((g - gl) / (h - hl + ridge), low, high)
        gain = 2 * (a * gl + b * (g - gl)) - a * a * (hl + ridge) - b * b * (h - hl + ridge)
        ok = (nl >= least) & (n - nl >= least) & ((b - a) * monotone[j] >= 0)
        if ok.any() and (k := int(np.argmax(np.where(ok, gain, -np.inf)))) is not None and gain[k] > best:
            best, found = gain[k], (j, k, float(a[k]), float(b[k]))
    return found
