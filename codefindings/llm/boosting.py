"""Gradient-boosted regression trees for a yes/no target, on small feature matrices."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Arrays by node: feature to test (-1 for a leaf), cut (go left if x <= cut), left child, value."""
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, value = np.array(self.left), np.array(self.value)
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = left[node] + (x[rows, feature[node]] > cut[node])
        return value[at]


@dataclass
class Boosted:
    """Sum of trees on the log-odds scale."""
    start: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        for tree in self.trees:
            raw += tree.predict(x)
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0,
          least: float = 1.0, bins: int = 32) -> Boosted:
    """Fit log loss with Newton steps; splits are searched over at most ``bins`` quantile cuts a feature."""
    if not len(x):
        return Boosted(0.0, [])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    raw = np.full(len(x), np.log(share / (1 - share)))
    model = Boosted(float(raw[0]), [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method='lower')) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], 'left') for j, c in enumerate(cuts)], 1)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-raw))
        tree = _tree(binned, cuts, y - p, p * (1 - p), depth, rate, l2, least)
        raw += tree.predict(x)
        model.trees.append(tree)
    return model


def _tree(binned, cuts, grad, hess, depth, rate, l2, least) -> Tree:
    tree = Tree()

    def node() -> int:
        tree.feature.append(-1)
        tree.cut.append(0.0)
        tree.left.append(0)
        tree.value.append(0.0)
        return len(tree.value) - 1

    def grow(at: int, rows: np.ndarray, left_depth: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        tree.value[at] = float(rate * g / (h + l2))
        if not left_depth:
            return
        best = (1e-6, -1, 0)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            gs = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(cut) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(cut) + 1))[:-1]
            gain = gs ** 2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g ** 2 / (h + l2)
            gain[(hs < least) | (h - hs < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] < 0:
            return
        low = node()
        node()
        tree.feature[at], tree.cut[at], tree.left[at] = best[1], float(cuts[best[1]][best[2]]), low
        goes = binned[rows, best[1]] <= best[2]
        grow(low, rows[goes], left_depth - 1)
        grow(low + 1, rows[~goes], left_depth - 1)

    grow(node(), np.arange(len(grad)), depth)
    return tree
