"""Exact Jaccard components of sets in memory, by recursive Voronoi regions of the Jaccard metric.

d(x, y) = 1 - |x & y| / |x | y| is a metric.  In a region a few pivots are chosen, every set's distance to each is computed and
sets within the threshold of a pivot are linked to it.  A set's home is its nearest pivot.  If x and y link and y's
home is q, then d(x, q) <= d(x, home(x)) + 2 * t and d(x, q) <= t + (radius of q), so x is replicated to the
regions of that window, and each region joins in the same way.  A region whose sets are all connected is finished; the leaf, a region that its pivots can't
split (distances near 1 say nothing: the windows hold more than 1.5 times its sets), is joined by prefix filtering with the region's own shingle counts, rarest first, which is exact
too.  Links are tested with integers: 100 * intersection >= percent * union.
"""

from __future__ import annotations

import numpy as np

PIVOTS = 6


class Region:
    """Sets as one array; `root` holds the components found so far."""

    def __init__(self, sets: list[np.ndarray], percent: int = 75) -> None:
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.root = np.arange(len(sets))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return self.root[at]
            self.root = up

    def linked(self, shared, a, b):
        return 100 * shared >= self.percent * (a + b - shared)

    def shared_with(self, at: np.ndarray, pivot: int) -> np.ndarray:
        """Intersection sizes of the sets `at` with the pivot's."""
        p = self.sets[pivot]
        if len(p) == 0:
            return np.zeros(len(at), dtype=np.int64)
        flat = np.concatenate([self.sets[i] for i in at])
        k = np.minimum(np.searchsorted(p, flat), len(p) - 1)
        sums = np.concatenate(([0], np.cumsum(p[k] == flat)))
        ends = np.cumsum(self.size[at])
        return sums[ends] - sums[ends - self.size[at]]

    def join(self) -> np.ndarray:
        """The smallest index of each set's component."""
        t = 1 - self.percent / 100
        stack = [np.flatnonzero(self.size > 0)]
        while stack:
            at = stack.pop()
            if len(at) < 2 or (self.roots(at) == self.roots(at)[0]).all():
                continue
            pivots, distance = [], []
            while len(pivots) < PIVOTS:
                roots = self.roots(at)
                if (roots == roots[0]).all():
                    break
                if pivots:  # the set farthest from all pivots, of those that none is linked to
                    far = np.min(distance, axis=0)
                    far[np.isin(roots, roots[[int(np.flatnonzero(at == p)[0]) for p in pivots]])] = -1
                    if far.max() < 0:
                        break
                    pivot = int(at[int(far.argmax())])
                else:
                    pivot = int(at[0])
                shared = self.shared_with(at, pivot)
                distance.append(1 - shared / np.maximum(1, self.size[at] + self.size[pivot] - shared))
                for i in at[self.linked(shared, self.size[at], self.size[pivot])]:
                    self.union(int(i), pivot)
                pivots.append(pivot)
            roots = self.roots(at)
            if (roots == roots[0]).all():
                continue
            d = np.stack(distance)
            home, own = d.argmin(axis=0), d.min(axis=0)
            regions = []
            for q in range(len(pivots)):
                member = home == q
                if not member.any():
                    continue
                near = (d[q] <= own + 2 * t + 1e-9) & (d[q] <= d[q][member].max() + t + 1e-9)
                regions.append(at[(member | near) & ~np.isin(at, pivots)])
            if sum(map(len, regions)) > 1.5 * len(at):
                self.prefix_join(at)
            else:
                stack += regions
        return self.roots(np.arange(len(self.sets)))

    def prefix_join(self, at: np.ndarray, other: np.ndarray | None = None, pairs: list[tuple[int, int]] | None = None) -> None:
        """Connect all linked sets within `at`, or of `at` and `other`.  Pairs that are connected already are not tested, except
        where `pairs` is given: it then gets every linked pair, the smaller index first."""
        every = at if other is None else np.concatenate((at, other))
        side = np.repeat([0, 1], [len(at), len(every) - len(at)])
        size = self.size[every]
        flat = np.concatenate([self.sets[i] for i in every])
        owner = np.repeat(np.arange(len(every)), size)
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((inverse, counts[inverse], owner))  # of each set, the region's rarest first
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        keep = place < np.repeat(size - -(-self.percent * size // 100) + 1, size)
        g, who = inverse[order][keep], owner[order][keep]
        shared = counts[g] > 1
        g, who = g[shared], who[shared]
        order = np.argsort(g, kind="stable")
        g, who = g[order], who[order]
        if len(g) == 0:
            return
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        tried: set[tuple[int, int]] = set()
        for a, b in zip(starts, np.append(starts[1:], len(g)), strict=True):
            if b - a < 2:
                continue
            group = who[a:b]
            roots = self.roots(every[group])
            if pairs is None and (roots == roots[0]).all():
                continue
            for k in range(len(group)):
                i = group[k]
                rest = group[k + 1 :]
                fit = (100 * np.minimum(size[rest], size[i]) >= self.percent * np.maximum(size[rest], size[i]))
                if pairs is None:
                    fit &= roots[k + 1 :] != roots[k]
                if other is not None:
                    fit &= side[rest] != side[i]
                for j in rest[fit]:
                    pair = (int(min(i, j)), int(max(i, j)))
                    if pair in tried or (pairs is None and self.find(int(every[i])) == self.find(int(every[j]))):
                        continue
                    tried.add(pair)
                    x, y = self.sets[every[i]], self.sets[every[j]]
                    if len(x) > len(y):
                        x, y = y, x
                    k2 = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    if self.linked(int((y[k2] == x).sum()), len(x), len(y)):
                        self.union(int(every[i]), int(every[j]))
                        if pairs is not None:
                            pairs.append((int(min(every[i], every[j])), int(max(every[i], every[j]))))
