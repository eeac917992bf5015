"""Nearest places by a k-d tree over points of the unit sphere, searched by many items at once."""

from __future__ import annotations

import numpy as np

#: Places of a leaf.
LEAF = 16
#: Squared chords that differ by less may be equal: rounding of double precision.
TIE = 1e-12


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


class KdTree:
    """Places split at the median of their widest coordinate, down to leaves. evaluations counts computed distances."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points, self.evaluations = points, 0
        self.root = self._split(0, len(points))
        self.points = points[self.order]

    def _split(self, a: int, z: int):
        if z - a <= LEAF:
            return a, z
        own = self.order[a:z]
        x = self.points[own]
        axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        mid = (z - a) // 2
        self.order[a:z] = own = own[np.argpartition(x[:, axis], mid)]
        return axis, self.points[own[mid], axis], self._split(a, a + mid), self._split(a + mid, z)

    def nearest(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of all places that are nearest to an item, or so near to it that rounding may hide it."""
        best = np.full(len(items), np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(node, who: np.ndarray) -> None:
            if len(node) == 2:
                a, z = node
                if a < z:
                    self.evaluations += len(who) * (z - a)
                    d = ((items[who][:, None] - self.points[None, a:z]) ** 2).sum(axis=2)
                    best[who] = np.minimum(best[who], d.min(axis=1))
                    i, j = np.nonzero(d <= best[who][:, None] + TIE)
                    found.append((who[i], a + j, d[i, j]))
                return
            axis, cut, low, high = node
            apart = items[who, axis] - cut
            for side, near, far in ((apart < 0, low, high), (apart >= 0, high, low)):
                if len(some := who[side]):
                    visit(near, some)
                    if (reach := apart[side] ** 2 <= best[some] + TIE).any():
                        visit(far, some[reach])

        if len(items) and len(self.points):
            visit(self.root, np.arange(len(items)))
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
        near = d <= best[i] + TIE
        return i[near], self.order[j[near]]
