"""A random forest for two classes in numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees on bootstrap samples; a node tries sqrt(features) features at up to 16 quantiles each, by Gini impurity."""

    def __init__(self, trees: int = 32, depth: int = 8, leaf: int = 4, seed: int = 5) -> None:
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.nodes = []
        for _ in range(self.trees):
            feature, cut, child, value = [], [], [], []
            stack = [(rng.integers(0, len(y), len(y)), 0, -1)]
            while stack:
                rows, depth, parent = stack.pop()
                me = len(value)
                if parent >= 0:
                    child[parent >> 1][parent & 1] = me
                feature.append(-1)
                cut.append(0.0)
                child.append([me, me])
                value.append(y[rows].mean() if len(rows) else 0.5)
                if depth == self.depth or len(rows) < 2 * self.leaf or value[-1] in (0.0, 1.0):
                    continue
                best = (np.inf, -1, 0.0)
                for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                    v = x[rows, f]
                    for c in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 16))):
                        left = v <= c
                        n = left.sum()
                        if self.leaf <= n <= len(rows) - self.leaf:
                            a, b = y[rows][left].mean(), y[rows][~left].mean()
                            g = n * a * (1 - a) + (len(rows) - n) * b * (1 - b)
                            if g < best[0]:
                                best = (g, f, c)
                if best[1] < 0:
                    continue
                feature[me], cut[me] = best[1], best[2]
                left = x[rows, best[1]] <= best[2]
                stack += [(rows[left], depth + 1, 2 * me), (rows[~left], depth + 1, 2 * me + 1)]
            self.nodes.append((np.array(feature), np.array(cut), np.array(child), np.array(value)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees of the share of class 1 in each row's leaf."""
        total = np.zeros(len(x))
        for feature, cut, child, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = child[at, (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]).astype(int)]
            total += value[at]
        return total / max(1, len(self.nodes))
