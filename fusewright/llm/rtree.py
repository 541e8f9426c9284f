"""An R-tree over count vectors, searched for pairs whose sets may overlap enough.

A set is hashed into groups; a point has the number of members in each group.  Two sets share at most the
sum over groups of the smaller count, and a set shares at most that sum against the box's upper corner with
any set below a node.
"""

from __future__ import annotations

import numpy as np

LEAF, QUERIES = 16, 512


class CountTree:
    """points: (m, groups) counts; sizes: (m,) set sizes.  Pairs need ratio (num, den): den * overlap >= num * (size + size)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int = 4, den: int = 9):
        self.num, self.den = num, den
        keys = [points[:, g] for g in np.argsort(points.var(axis=0))[-3:]]
        self.order = np.lexsort([*keys, sizes])  # neighbours of like size, then of like counts, share a leaf
        self.points, self.sizes = points[self.order].astype(np.int32), sizes[self.order].astype(np.int64)
        self.levels = []  # from the leaves up: upper corner and least size of every node
        top, least = self.points, self.sizes
        while len(top) > LEAF:
            edges = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, edges), np.minimum.reduceat(least, edges)
            self.levels.append((top, least))

    def _enough(self, q, corner, least):
        shared = np.minimum(self.points[q], corner).sum(axis=1, dtype=np.int64)
        return self.den * np.minimum(shared, self.sizes[q]) >= self.num * (self.sizes[q] + least)

    def pairs(self):
        """Yields (later, earlier, bound) positions in ``order`` of pairs that the bound lets through, by query."""
        m = len(self.sizes)
        for at in range(0, m, QUERIES):
            q = np.arange(at, min(m, at + QUERIES))
            roots = len(self.levels[-1][0]) if self.levels else m
            node = np.tile(np.arange(roots), len(q))
            q = np.repeat(q, roots)
            for depth in range(len(self.levels) - 1, -2, -1):
                span = LEAF ** (depth + 1)
                q, node = (x[node * span < q] for x in (q, node))  # something below comes before the query
                if depth >= 0:
                    top, least = self.levels[depth]
                    below = len(self.levels[depth - 1][0]) if depth else m
                else:
                    top, least = self.points, self.sizes
                ok = np.concatenate([self._enough(q[i : i + 65536], top[node[i : i + 65536]], least[node[i : i + 65536]]) for i in range(0, len(q), 65536)]) if len(q) else np.empty(0, bool)
                q, node = q[ok], node[ok]
                if depth >= 0:
                    q = np.repeat(q, LEAF)
                    node = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                    q, node = q[node < below], node[node < below]
            if len(q):
                yield q, node
