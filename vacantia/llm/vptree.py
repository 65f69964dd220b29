"""Vantage-point trees over 64-bit fingerprints under the Hamming distance.

A node holds a vantage point and a distance mu. Points at up to mu go to its left, the others to its right; those at
up to mu + radius also go left as guests. Two points within the radius are, by the triangle inequality, together in at
least one child: if they part at a node, the far one is less than radius beyond mu and so a guest on the left.
"""

from __future__ import annotations

import numpy as np

#: Vantage points tried for a node, and points by which they are judged.
TRIED, JUDGED = 24, 2048
#: Points that are compared directly.
DIRECT = 384


def distances(points: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(to)).astype(np.int64)


def best_split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and mu that leave least work in the children; None where no split saves a fifth of it."""
    some = points if len(points) <= JUDGED else points[rng.choice(len(points), JUDGED, replace=False)]
    best, least = None, 0.8
    for to in some[rng.choice(len(some), min(TRIED, len(some)), replace=False)]:
        upto = np.cumsum(np.bincount(distances(some, to), minlength=65 + radius)) / len(some)
        left, home = upto[radius : 64 + radius], upto[:64]
        work = left**2 + (1 - home) ** 2
        mu = int(work.argmin())
        if 0 < home[mu] < 1 and work[mu] < least:
            best, least = (np.uint64(to), mu), work[mu]
    return best


class Tree:
    """A tree of shards from a sample; `route` sends every point to its shard, and as a guest to all it may have links in."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int, seed: int = 42):
        self.radius, self.nodes, self.shards = radius, [], 0
        rng = np.random.default_rng(seed)
        sample = np.unique(sample.astype(np.uint64))
        self.root = self._grow(sample, max(8, len(sample) // max(1, shards)), rng)

    def _grow(self, points: np.ndarray, leaf: int, rng) -> int:
        split = best_split(points, self.radius, rng) if len(points) > leaf else None
        if split is None:
            self.shards += 1
            return -self.shards
        to, mu = split
        d = distances(points, to)
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (to, mu, self._grow(points[d <= mu], leaf, rng), self._grow(points[d > mu], leaf, rng))
        return at

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a point, shard) for all shards of each point."""
        out, todo = [], [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), -node - 1)))
                continue
            to, mu, left, right = self.nodes[node]
            d = distances(points[at], to)
            todo += [(left, at[d <= mu + self.radius]), (right, at[d > mu])]
        return np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)]), np.concatenate([x for _, x in out] or [np.zeros(0, np.int64)])


def _direct(points: np.ndarray, at: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links that join what is within the radius among points[at], by comparing all; in blocks, a forest of each."""
    out = []
    for i in range(0, len(at), DIRECT):
        a = at[i : i + DIRECT]
        for j in range(i, len(at), DIRECT):
            b = at[j : j + DIRECT]
            near = np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= radius
            if i == j:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            x, y = np.nonzero(near)
            x, y = a[x], b[y]
            label = np.concatenate([a, b])
            keys = np.unique(label)
            own = np.arange(len(keys))
            px, py = np.searchsorted(keys, x), np.searchsorted(keys, y)
            while True:  # least label among neighbours until nothing changes
                new = own.copy()
                np.minimum.at(new, px, own[py])
                np.minimum.at(new, py, own[px])
                new = new[new]
                if (new == own).all():
                    break
                own = new
            moved = np.flatnonzero(own != np.arange(len(keys)))
            out.append(np.stack([keys[moved], keys[own[moved]]], axis=1))
    return out


def forest(points: np.ndarray, radius: int, seed: int = 42) -> np.ndarray:
    """Links (i, j) between distinct `points` that connect exactly what links within the radius connect; under len(points)."""
    rng, found, todo = np.random.default_rng(seed), [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        split = best_split(points[at], radius, rng) if len(at) > DIRECT else None
        if split is None:
            found += _direct(points, at, radius)
            continue
        d = distances(points[at], split[0])
        todo += [at[d <= split[1] + radius], at[d > split[1]]]
    parent: dict[int, int] = {}

    def top(i: int) -> int:
        while parent.get(i, i) != i:
            parent[i] = parent.get(parent[i], parent[i])
            i = parent[i]
        return i

    for i, j in np.concatenate(found).tolist() if found else ():
        a, b = top(i), top(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([(i, top(i)) for i in parent if top(i) != i], dtype=np.int64).reshape(-1, 2)
