"""Points of one leaf in small buckets that lie close together.

A look at the neighbours of a bucket's points takes only the buckets whose boxes are near enough,
so a leaf costs about its points times their neighbours instead of its points squared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BUCKET = 64


def bucket_order(p: np.ndarray, size: int = BUCKET) -> np.ndarray:
    """An order of the points in which each ``size`` in a row lie close together: halves along the widest side."""
    order, open_parts = np.arange(len(p)), [(0, len(p))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low <= size:
            continue
        part = order[low:high]
        own = p[part]
        half = (high - low + size) // (2 * size) * size
        order[low:high] = part[np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half - 1)]
        open_parts += [(low, low + half), (low + half, high)]
    return order


class Buckets:
    """Points in bucket order, the last bucket filled up with points at infinity."""

    def __init__(self, p: np.ndarray, size: int = BUCKET):
        self.order, self.n, self.size = bucket_order(p, size), len(p), size
        self.count = -(-len(p) // size)
        self.p = self.padded(p, np.inf)
        whole = self.p.reshape(self.count, size, -1)
        self.low = whole.min(axis=1)
        self.high = np.where(np.isfinite(whole), whole, -np.inf).max(axis=1)
        # One array for each dimension.
        self.axes = [np.ascontiguousarray(self.p[:, i]).reshape(self.count, size) for i in range(p.shape[1])]

    def padded(self, values: np.ndarray, fill) -> np.ndarray:
        """Values of the points in bucket order, with ``fill`` for what the last bucket lacks."""
        out = np.full((self.count * self.size, *values.shape[1:]), fill, np.result_type(values, type(fill)))
        out[: self.n] = values[self.order]
        return out

    def near(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least distance of each bucket's box to a box; never more than that of two of their points."""
        side = np.maximum(np.maximum(self.low - high, low - self.high), 0)
        return np.sqrt((side * side).sum(axis=1)) * (1 - 1e-12)

    def far(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Largest distance of each bucket's box to a box."""
        side = np.maximum(np.abs(self.high - low), np.abs(high - self.low))
        return np.sqrt((side * side).sum(axis=1)) * (1 + 1e-12)

    def distances(self, q: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Distances of every q to the points of the taken buckets, summed dimension by dimension."""
        total = None
        for i, axis in enumerate(self.axes):
            step = q[:, i, None] - axis[taken].reshape(1, -1)
            step *= step
            total = step if total is None else np.add(total, step, out=total)
        return np.sqrt(total, out=total)


def _in_buckets(b: Buckets, core: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lightest edge of each point to another component in its own bucket: weight, and the other point."""
    weight, to = np.full(len(core), np.inf), np.zeros(len(core), np.int64)
    group = max(1, (1 << 19) // b.size**2)
    for start in range(0, b.count, group):
        some = slice(start, min(start + group, b.count))
        total = 0.0
        for axis in b.axes:
            with np.errstate(invalid="ignore"):
                step = axis[some, :, None] - axis[some, None, :]
            step *= step
            total = total + step
        c, k = core.reshape(b.count, -1)[some], comp.reshape(b.count, -1)[some]
        reach = np.maximum(np.sqrt(total), np.maximum(c[:, :, None], c[:, None, :]))
        reach[k[:, :, None] == k[:, None, :]] = np.inf
        at = reach.argmin(axis=2)
        rows = slice(some.start * b.size, some.stop * b.size)
        weight[rows] = np.take_along_axis(reach, at[:, :, None], axis=2).ravel()
        to[rows] = (at + b.size * np.arange(some.start, some.stop)[:, None]).ravel()
    weight[np.isnan(weight)] = np.inf
    return weight, to


def spanning_edges(p: np.ndarray, core: np.ndarray, size: int = BUCKET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lightest spanning tree of points under mutual reachability; points with an infinite core are left out.

    In each round every component takes a lightest edge to another one.  Of each point is known a bound below all its
    edges to other components, and perhaps one such edge.  Only points whose bound is below what their component has
    found look further, into buckets within that reach that hold another component.
    """
    b = Buckets(p, size)
    core = b.padded(core.astype(float), np.inf)
    n = len(core)
    # Points at infinity are one component that has no edges.
    comp = np.where(np.arange(n) < b.n, np.arange(n), n)
    least = core.reshape(b.count, -1).min(axis=1)
    low, edge, to = core.copy(), np.full(n, np.inf), np.zeros(n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        stale = comp[to] == comp
        edge[stale] = np.inf
        weight, other = _in_buckets(b, core, comp)
        better = weight < edge
        edge[better], to[better] = weight[better], other[better]
        reach = np.full(n + 1, np.inf)
        np.minimum.at(reach, comp, edge)
        by_bucket = comp.reshape(b.count, -1)
        only = np.where((by_bucket == by_bucket[:, :1]).all(axis=1), by_bucket[:, 0], -1)
        doubtful = (low < reach[comp]) & (core < np.inf)
        for i in np.flatnonzero(doubtful.reshape(b.count, -1).any(axis=1)).tolist():
            rows = np.arange(i * b.size, (i + 1) * b.size)
            rows = rows[low[rows] < np.minimum(reach[comp[rows]], np.where(core[rows] < np.inf, np.inf, -np.inf))]
            if not len(rows):
                continue
            own = comp[rows]
            r, q = reach[own].max(), b.p[rows]
            look = (b.near(q.min(axis=0), q.max(axis=0)) < r) & (least < r)
            if (own == own[0]).all():
                look &= only != own[0]
            taken = np.flatnonzero(look)
            low[rows] = r
            if not len(taken):
                continue
            there = np.maximum(b.distances(q, taken), core.reshape(b.count, -1)[taken].reshape(1, -1))
            there[own[:, None] == by_bucket[taken].reshape(1, -1)] = np.inf
            at = there.argmin(axis=1)
            weight = np.maximum(there[np.arange(len(rows)), at], core[rows])
            low[rows] = np.minimum(weight, r)
            better = np.flatnonzero(weight < edge[rows])
            edge[rows[better]], to[rows[better]] = weight[better], taken[at[better] // b.size] * b.size + at[better] % b.size
            np.minimum.at(reach, own, weight)
        # The lightest edge of each component; equal ones that close a circle are left out.
        order = np.lexsort((edge, comp))
        first = order[np.flatnonzero(np.diff(comp[order], prepend=-1))]
        first = first[edge[first] < np.inf]
        if not len(first):
            break
        first = first[np.argsort(edge[first], kind="stable")]
        root = list(range(n + 1))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        taken_edges = []
        for x, u, v in zip(first.tolist(), comp[first].tolist(), comp[to[first]].tolist()):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
                taken_edges.append(x)
        taken_edges = np.array(taken_edges, np.int64)
        found.append((b.order[taken_edges], b.order[to[taken_edges]], edge[taken_edges]))
        names = np.unique(comp)
        name = np.arange(n + 1)
        name[names] = [find(i) for i in names.tolist()]
        comp = name[comp]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, z, weight = (np.concatenate(x) for x in zip(*found))
    return a, z, weight
