"""Gradient-boosted trees on binned features, with monotonic constraints, kept as flat numpy node arrays.

Training is for a bounded labelled sample on the driver; scoring walks all rows through the node arrays at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees: a leaf has feature -1 and its value; others send x <= threshold to left, else to left + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Logistic loss, Newton leaves, splits by histogram gain.

    monotone: +1, 0 or -1 per feature. A split that breaks its feature's direction isn't taken, and below a split
    on a constrained feature the children's values stay on either side of their middle, so that the whole model is
    monotone in that feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if len(x) else np.empty((0, x.shape[1]), int)
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(x), base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def leaf(v: float) -> int:
        for arr, item in ((feature, -1), (threshold, 0.0), (left, 0), (value, v)):
            arr.append(item)
        return len(feature) - 1

    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        newton = lambda g, h: g / (h + l2)
        root = leaf(0.0)
        roots.append(root)
        todo = [(root, np.arange(len(x)), depth, -np.inf, np.inf)]
        step = np.zeros(len(x))
        while todo:
            node, own, levels, lo, hi = todo.pop()
            g, h = grad[own].sum(), hess[own].sum()
            best = (1e-6, None)
            if levels and len(own) >= 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = code[own, j]
                    n = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                    gl = np.cumsum(np.bincount(c, grad[own], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, hess[own], len(e) + 1))[:-1]
                    a, b = np.clip(newton(gl, hl), lo, hi), np.clip(newton(g - gl, h - hl), lo, hi)
                    gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                    fine = (n >= least) & (len(own) - n >= least) & (monotone[j] * (b - a) >= 0)
                    gain = np.where(fine, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, a[k], b[k]))
            if best[1] is None:
                value[node] = float(rate * np.clip(newton(g, h), lo, hi))
                step[own] = value[node]
                continue
            j, k, a, b = best[1]
            goes = code[own, j] <= k
            feature[node], threshold[node] = j, float(edges[j][k])
            left[node] = leaf(0.0)
            leaf(0.0)
            middle = (a + b) / 2
            bounds = ((lo, hi), (lo, hi)) if not monotone[j] else (((lo, middle), (middle, hi)) if monotone[j] > 0 else ((middle, hi), (lo, middle)))
            todo.append((left[node], own[goes], levels - 1, *bounds[0]))
            todo.append((left[node] + 1, own[~goes], levels - 1, *bounds[1]))
        margin += step
    return Trees(np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(value, float), np.array(roots, np.int64), depth, base)
