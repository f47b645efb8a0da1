"""Gradient-boosted trees for binary labels over small integer features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class BoostedTrees:
    """Newton boosting on the logistic loss; complete trees of one depth, splits on feature values up to 255.

    ``scale`` and ``shift`` calibrate the raw sum on rows that grew no tree, so that probability() can be
    held against a threshold.
    """

    depth: int = 5
    rounds: int = 80
    rate: float = 0.2
    ridge: float = 1.0
    least: float = 4.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        x = np.clip(x, 0, 255).astype(np.int64)
        held = np.arange(len(y)) % 5 == 0
        xt, yt = x[~held], y[~held].astype(float)
        rate = np.clip(yt.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        raw = np.full(len(yt), self.bias)
        for _ in range(self.rounds):
            p = sigmoid(raw)
            tree = self._grow(xt, p - yt, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            raw += self._apply(tree, xt)
        self._calibrate(self.raw(x[held]), y[held].astype(float))
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f in range(x.shape[1]):
                key = (node - first) * 256 + x[:, f]
                gl = np.bincount(key, g, width * 256).reshape(width, 256).cumsum(axis=1)
                hl = np.bincount(key, h, width * 256).reshape(width, 256).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least / 16) | (ht - hl < self.least / 16)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = at[better]
            node = 2 * node + 1 + (x[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return feature, cut, -self.rate * gs / (hs + self.ridge)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return leaf[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 0, 255).astype(np.int64)
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += self._apply(tree, x)
        return out

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Platt's scaling, with his smoothed targets, by Newton steps."""
        if not len(y) or y.min() == y.max():
            return
        n1, n0 = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a = np.array([1.0, 0.0])
        design = np.column_stack([raw, np.ones(len(raw))])
        for _ in range(50):
            p = sigmoid(design @ a)
            grad = design.T @ (p - t) + np.array([1e-3 * (a[0] - 1), 0])
            hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            a -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.scale, self.shift = float(max(a[0], 1e-3)), float(a[1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw(x) + self.shift)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which the accepted of p have at least this share of positives."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= precision)
    return float(p[order][good[-1]]) if len(good) else 1.0
