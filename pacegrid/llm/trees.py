"""Gradient-boosted trees in numpy, with monotonic constraints and flat scoring.

Trees grow level by level on quantile bins.  A constrained feature may only
split so that the child on the higher side has the higher (+1) or lower (-1)
value; both children of such a split are bounded by the midpoint, so the
constraint holds for the whole function.  A forest is five arrays: feature,
threshold, left, right and value of every node, leaves pointing to themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; all rows go down one tree together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                above = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(above, self.right[node], self.left[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, monotone: np.ndarray,
    trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, ridge: float = 2.0, least: float = 5.0,
) -> Forest:
    """Logistic boosting of ``y`` (0 or 1); ``monotone`` has -1, 0 or 1 for each feature."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    share = float(np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (y - p) * weight, p * (1 - p) * weight
        root = len(nodes)
        roots.append(root)
        nodes.append([0, np.inf, root, root, rate * g.sum() / (h.sum() + ridge)])
        where = np.full(n, root)
        bounds = {root: (-np.inf, np.inf)}
        open_nodes = [root]
        for _ in range(depth):
            place = np.full(len(nodes), -1)
            place[open_nodes] = np.arange(len(open_nodes))
            slot = place[where]
            rows = np.flatnonzero(slot >= 0)
            best: dict[int, tuple] = {}
            for f in range(width):
                size = len(cuts[f]) + 1
                key = slot[rows] * size + binned[rows, f]
                gs = np.bincount(key, g[rows], len(open_nodes) * size).reshape(-1, size)
                hs = np.bincount(key, h[rows], len(open_nodes) * size).reshape(-1, size)
                gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gr, hr = gt - gl, ht - hl
                a, b = gl / (hl + ridge), gr / (hr + ridge)
                gain = gl * a + gr * b - gt * gt / (ht + ridge)
                fits = (hl * 4 >= least) & (hr * 4 >= least)
                if monotone[f]:
                    fits &= (b - a) * monotone[f] >= 0
                gain = np.where(fits, gain, -1)
                for i, node in enumerate(open_nodes):
                    if gain.shape[1] and (c := int(gain[i].argmax())) >= 0 and gain[i, c] > max(1e-6, best.get(node, (0,))[0]):
                        best[node] = (gain[i, c], f, c, a[i, c], b[i, c])
            grown = []
            for node, (_, f, c, a, b) in best.items():
                low, high = bounds[node]
                a, b = np.clip([rate * a, rate * b], low, high)
                middle = (a + b) / 2
                left, right = len(nodes), len(nodes) + 1
                bounds[left] = bounds[right] = (low, high)
                if monotone[f] > 0:
                    bounds[left], bounds[right] = (low, middle), (middle, high)
                elif monotone[f] < 0:
                    bounds[left], bounds[right] = (middle, high), (low, middle)
                nodes.append([0, np.inf, left, left, a])
                nodes.append([0, np.inf, right, right, b])
                nodes[node][:4] = [f, cuts[f][c], left, right]
                here = where == node
                where[here] = np.where(binned[here, f] > c, right, left)
                grown += [left, right]
            open_nodes = grown
            if not grown:
                break
        score += np.array([v[4] for v in nodes])[where]
    flat = np.array(nodes, float) if nodes else np.zeros((0, 5))
    return Forest(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), base, depth)
