"""Gradient-boosted regression trees for two classes, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Additive trees on the log-odds; each leaf takes a Newton step, splits are sought over quantile cuts."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, cuts: int = 16):
        self.rounds, self.depth, self.rate, self.ridge, self.cuts = rounds, depth, rate, ridge, cuts
        self.base, self.trees, self._flat = 0.0, [], None

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # bin k: over cuts 0 to k-1
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, p - y, p * (1 - p), np.arange(len(y)), edges, self.depth)
            self.trees.append(tree)
            f += _values(tree, x)
        return self

    def split(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
        """(feature, cut) with the best gain; the first of equal ones."""
        gain_of = lambda a, b: a * a / (b + self.ridge)
        total_g, total_h = g.sum(), h.sum()
        best, found = 1e-6, None
        for j, cuts in enumerate(edges):
            a = np.cumsum(np.bincount(bins[j], g, len(cuts) + 1))[:-1]
            b = np.cumsum(np.bincount(bins[j], h, len(cuts) + 1))[:-1]
            gain = np.where((b > 0.5) & (total_h - b > 0.5), gain_of(a, b) + gain_of(total_g - a, total_h - b) - gain_of(total_g, total_h), 0)
            if len(gain) and gain.max() > best + 1e-9:
                best, found = float(gain.max()), (j, int(gain.argmax()))
        return found

    def _grow(self, bins, g, h, rows, edges, depth):
        found = self.split(bins[:, rows], g[rows], h[rows], edges) if depth else None
        if found is None:
            return float(-self.rate * g[rows].sum() / (h[rows].sum() + self.ridge))
        j, k = found
        low = bins[j, rows] <= k
        return (j, float(edges[j][k]), self._grow(bins, g, h, rows[low], edges, depth - 1), self._grow(bins, g, h, rows[~low], edges, depth - 1))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All trees at once, a level at a time."""
        if self._flat is None or self._flat[0] != len(self.trees):
            self._flat = len(self.trees), *_flattened(self.trees)
        _, roots, feature, cut, low, high, value = self._flat
        if not len(roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(roots, (len(x), len(roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, feature[at]] <= cut[at], low[at], high[at])
        return 1 / (1 + np.exp(-self.base - value[at].sum(1)))


def _flattened(trees: list) -> tuple[np.ndarray, ...]:
    """(roots, feature, cut, low, high, value) of all nodes; a leaf leads to itself."""
    nodes: list[list] = []

    def add(tree) -> int:
        k = len(nodes)
        nodes.append([0, 0.0, k, k, tree if not isinstance(tree, tuple) else 0.0])
        if isinstance(tree, tuple):
            nodes[k][:2] = tree[:2]
            nodes[k][2], nodes[k][3] = add(tree[2]), add(tree[3])
        return k

    roots = np.array([add(t) for t in trees], np.int64)
    columns = list(zip(*nodes, strict=True)) or [()] * 5
    return roots, *(np.array(c, float if k in (1, 4) else np.int64) for k, c in enumerate(columns))


def _values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    at = x[:, j] <= cut
    out = np.empty(len(x))
    out[at], out[~at] = _values(low, x[at]), _values(high, x[~at])
    return out
