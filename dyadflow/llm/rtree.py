"""A packed R-tree over count vectors, searched by an upper bound of the overlap."""

from __future__ import annotations

import numpy as np

LEAF, FAN = 16, 8


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """The least intersection of sets of n and m elements with 100 * intersection >= percent * union."""
    return -(-(percent * (n + m)) // (100 + percent))


def smaller_sum(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.minimum(v, w).sum(-1, dtype=np.int64)


class CountTree:
    """Points are counts of a set's elements by group. Two sets share at most the sum of the smaller counts, so a box, by its
    largest counts, bounds the overlap with all sets in it from above; boxes that can't reach the overlap that their
    sizes ask for are left out."""

    def __init__(self, points: np.ndarray, percent: int):
        """points: a row of counts each; the sums are the sizes."""
        self.percent = percent
        sizes = points.sum(1, dtype=np.int64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        if len(points) <= LEAF:
            self.order, self.points, self.sizes = np.arange(len(points)), points, sizes
            return
        # Packed like a sort-tile tree: slabs by size, in a slab by the two coordinates that reach furthest.
        reach = points.max(0).astype(np.int64) - points.min(0)
        first, second = np.argsort(-reach, kind="stable")[:2]
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * FAN)
        self.order = np.lexsort((points[:, second], points[:, first], slab))
        self.points, self.sizes = points[self.order], sizes[self.order]
        most, low, high, width = self.points, self.sizes, self.sizes, LEAF
        while len(low) > 1:
            at = np.arange(0, len(low), width)
            most, low, high = np.maximum.reduceat(most, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((width, most, low, high))
            width = FAN

    def search(self, q: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The points, by their row, whose bound with q reaches the overlap that is asked for, and the bounds. `allowed`: which
        points to look at."""
        n, t = int(q.sum(dtype=np.int64)), self.percent
        least, largest = -(-t * n // 100), 100 * n // t
        here = np.arange(len(self.levels[-1][2]) if self.levels else len(self.sizes))
        for k in range(len(self.levels) - 1, -1, -1):
            width, most, low, high = self.levels[k]
            here = here[(high[here] >= least) & (low[here] <= largest)]
            here = here[smaller_sum(most[here], q) >= least_overlap(n, np.maximum(low[here], least), t)]
            below = len(self.levels[k - 1][2]) if k else len(self.sizes)
            here = (here[:, None] * width + np.arange(width)).ravel()
            here = here[here < below]
        if allowed is not None:
            here = here[allowed[self.order[here]]]
        s = self.sizes[here]
        here = here[(s >= least) & (s <= largest)]
        bound = smaller_sum(self.points[here], q)
        good = bound >= least_overlap(n, self.sizes[here], t)
        return self.order[here[good]], bound[good]
