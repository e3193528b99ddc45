"""A cover tree over vectors for searches by inner product.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and a query
a 0 there: inner products stay as they are, and all vectors lie on a sphere, so
nearness and inner product agree. A node covers its points within its radius; its
children are points of it that are more than half the radius apart and cover the rest
within that half. By Cauchy and Schwarz, the inner product of a query q with any point of a
node differs from that with its centre by at most |q| times the radius.
"""

from __future__ import annotations

import io
from collections import deque
from typing import NamedTuple

import numpy as np

LEAF = 32
#: Nodes that are opened together, those of the largest bounds.
_OPENED = 64
_EXACT = 2.0**53


class Window(NamedTuple):
    """Scores from ``low`` to ``high``, of which the ``k`` largest are sought."""

    low: float
    high: float
    k: int


class CoverTree:
    """Nodes in the order of their levels, children of a node in a row.

    ``vectors`` are whole numbers. ``order`` lists the points so that those of a node lie
    in a row, from ``first`` to ``last``; ``child`` and ``children`` say where its
    children begin and how many there are."""

    def __init__(self, vectors: np.ndarray, **parts: np.ndarray):
        self.vectors = vectors
        self.plain = vectors.astype(np.float64)
        self.__dict__.update(parts)
        self.centres = self.plain[self.centre]
        self.most = float(np.sqrt((self.plain**2).sum(axis=1).max(initial=0)))

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int = LEAF) -> CoverTree:
        """Level by level. All points have the norm M, so the square of a distance is
        2 M^2 - 2 <x, y>."""
        plain = vectors.astype(np.float64)
        squares = (plain**2).sum(axis=1)
        most = float(squares.max(initial=0))
        lifted = np.column_stack([plain, np.sqrt(np.maximum(most - squares, 0))])
        equal = 1e-7 * np.sqrt(most)

        def distances(points: np.ndarray, centre: int) -> np.ndarray:
            square = 2 * (most - lifted[points] @ lifted[centre])
            found = np.sqrt(np.maximum(square, 0))
            # Copies lie at no distance, whatever the rounding.
            near = np.flatnonzero(found <= equal + 1e-3)
            found[near] = np.sqrt(((lifted[points[near]] - lifted[centre]) ** 2).sum(axis=1))
            return found

        centre: list[int] = []
        radius: list[float] = []
        child: list[int] = []
        children: list[int] = []
        bags: list[np.ndarray] = []

        def node(points: np.ndarray, far: np.ndarray) -> int:
            centre.append(int(points[0]))
            radius.append(float(far.max()))
            child.append(0)
            children.append(0)
            bags.append(points)
            return len(centre) - 1

        everyone = np.arange(len(vectors))
        waiting: deque[int] = deque()
        if len(vectors):
            waiting.append(node(everyone, distances(everyone, 0)))
        while waiting:
            k = waiting.popleft()
            points = bags[k]
            if len(points) <= leaf or radius[k] == 0:
                continue
            reach = radius[k] / 2
            child[k] = len(centre)
            left = points
            while len(left):
                far = distances(left, int(left[0]))
                inside = far <= reach
                inside[0] = True
                waiting.append(node(left[inside], far[inside]))
                left = left[~inside]
            children[k] = len(centre) - child[k]
            bags[k] = bags[k][:0]
        # Points in the order of a walk over the leaves; inner nodes hold their children's.
        size = [0] * len(centre)
        for k in reversed(range(len(centre))):
            size[k] = len(bags[k]) or sum(size[child[k] : child[k] + children[k]])
        first = [0] * len(centre)
        for k in range(len(centre)):
            at = first[k]
            for c in range(child[k], child[k] + children[k]):
                first[c] = at
                at += size[c]
        order = np.zeros(len(vectors), np.int64)
        for k, bag in enumerate(bags):
            order[first[k] : first[k] + len(bag)] = bag
        return cls(
            vectors,
            order=order,
            centre=np.array(centre, np.int64),
            radius=np.array(radius),
            child=np.array(child, np.int64),
            children=np.array(children, np.int64),
            first=np.array(first, np.int64),
            last=np.array(first, np.int64) + np.array(size, np.int64),
        )

    PARTS = ("order", "centre", "radius", "child", "children", "first", "last")

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **{p: getattr(self, p) for p in self.PARTS}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, dumped: bytes) -> tuple[CoverTree, dict[str, np.ndarray]]:
        """The tree, and what was dumped with it."""
        with np.load(io.BytesIO(dumped)) as found:
            parts = dict(found)
        tree = cls(parts.pop("vectors"), **{p: parts.pop(p) for p in cls.PARTS})
        return tree, parts

    def exact(self, points: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products of whole numbers: in doubles while they hold them."""
        if self.most * float(np.sqrt((query.astype(np.float64) ** 2).sum())) < _EXACT:
            return (self.plain[points] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[points].astype(np.int64) @ query.astype(np.int64)

    def search(
        self, query: np.ndarray, windows: list[Window], allowed: np.ndarray, ids: np.ndarray
    ) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """([(points, scores)] of each window, nodes opened): the k allowed points of the
        largest inner products within the window, ties to the smaller id.

        Best first: the nodes of the largest bounds are opened together. A node is left
        out where no window can take any of its points: its bounds lie outside, or below
        the window's k-th best so far."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        opened = 0
        if not len(self.vectors) or not windows:
            return best, opened
        plain = query.astype(np.float64)
        norm = float(np.sqrt((plain**2).sum()))
        slack = 1e-9 * norm * self.most + 1e-6
        low = np.array([w.low for w in windows], float)
        high = np.array([w.high for w in windows], float)
        floor = low.copy()

        def take(points: np.ndarray) -> None:
            points = points[allowed[points]]
            if not len(points):
                return
            scores = self.exact(points, query)
            for w, window in enumerate(windows):
                inside = (scores >= floor[w]) & (scores <= window.high)
                if not inside.any():
                    continue
                p = np.concatenate([best[w][0], points[inside]])
                s = np.concatenate([best[w][1], scores[inside]])
                if len(s) > window.k:
                    kept = s >= np.partition(s, len(s) - window.k)[len(s) - window.k]
                    p, s = p[kept], s[kept]
                    order = np.lexsort((p, ids[p], -s))[: window.k]
                    p, s = p[order], s[order]
                best[w] = p, s
                if len(s) == window.k:
                    floor[w] = max(floor[w], float(s.min()))

        def bounds(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            middle = self.centres[nodes] @ plain
            reach = norm * self.radius[nodes] + slack
            return middle - reach, middle + reach

        nodes = np.zeros(1, np.int64)
        least, most = bounds(nodes)
        while len(nodes):
            use = ((most[:, None] >= floor) & (least[:, None] <= high)).any(axis=1)
            nodes, least, most = nodes[use], least[use], most[use]
            if not len(nodes):
                break
            if len(nodes) > _OPENED:
                now = np.argpartition(-np.minimum(most, high.max()), _OPENED)[:_OPENED]
                rest = np.ones(len(nodes), bool)
                rest[now] = False
            else:
                now, rest = np.arange(len(nodes)), np.zeros(len(nodes), bool)
            chosen = nodes[now]
            opened += len(chosen)
            inner = self.children[chosen] > 0
            below = _ranges(self.child[chosen[inner]], self.children[chosen[inner]])
            lower, upper = bounds(below)
            use = ((upper[:, None] >= floor) & (lower[:, None] <= high)).any(axis=1)
            below, lower, upper = below[use], lower[use], upper[use]
            # A leaf of one point is as soon verified as it is put back.
            single = self.last[below] - self.first[below] == 1
            leaves = np.concatenate([chosen[~inner], below[single]])
            opened += int(single.sum())
            take(self.order[_ranges(self.first[leaves], self.last[leaves] - self.first[leaves])])
            nodes = np.concatenate([nodes[rest], below[~single]])
            least = np.concatenate([least[rest], lower[~single]])
            most = np.concatenate([most[rest], upper[~single]])
        out = []
        for p, s in best:
            order = np.lexsort((p, ids[p], -s))
            out.append((p[order], s[order]))
        return out, opened


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after another."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    return np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])
