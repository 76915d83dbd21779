"""Neighbours, windows and spanning trees of one cloud in memory that grows with its points alone.

Points lie in compact blocks (strips by the first column, cut by the last), and
only blocks are compared whose boxes may hold what is asked. Results are those
of a matrix of all distances: bounds are rounded like distances, equal distances
go by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a block (of windows), distances that a step holds, and neighbours listed for a spanning tree.
SIZE, WINDOW_SIZE, STEP, LISTED = 128, 32, 1 << 21, 32


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.square(np.subtract.outer(a[:, 0], b[:, 0]))
    for k in range(1, a.shape[1]):
        step = np.subtract.outer(a[:, k], b[:, k])
        out += np.square(step, out=step)
    return np.sqrt(out, out=out)


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, equal ones by column."""
    if d.shape[1] <= k:
        return np.argsort(d, 1, kind="stable")
    near = np.sort(np.argpartition(d, k - 1, 1)[:, :k], 1)
    own = np.take_along_axis(d, near, 1)
    kth = own.max(1, keepdims=True)
    for i in np.flatnonzero((d <= kth).sum(1) > k):  # more ties at the kth than places
        some = np.flatnonzero(d[i] <= kth[i])
        near[i] = np.sort(some[np.argsort(d[i, some], kind="stable")[:k]])
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)


class Plane:
    """Points of a cloud in blocks with their boxes."""

    def __init__(self, x: np.ndarray, size: int = SIZE):
        self.x, parts = x, max(1, int(np.ceil(np.sqrt(len(x) / size))))
        self.blocks = []
        for strip in np.array_split(np.argsort(x[:, 0], kind="stable"), parts):
            self.blocks += [np.sort(b) for b in np.array_split(strip[np.argsort(x[strip, -1], kind="stable")], parts) if len(b)]
        self.counts = np.array([len(b) for b in self.blocks])
        self.low, self.high = (np.array([f(x[b], axis=0) for b in self.blocks]) for f in (np.min, np.max))

    def gaps(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least distance from a box to a point of each block."""
        return np.sqrt((np.maximum(0, np.maximum(self.low - high, low - self.high)) ** 2).sum(1))

    def spans(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Largest distance from a point of a box to one of each block."""
        return np.sqrt((np.maximum(self.high - low, high - self.low) ** 2).sum(1))

    def points(self, chosen: np.ndarray) -> np.ndarray:
        """Positions of the points of the chosen blocks, ascending."""
        return np.sort(np.concatenate([self.blocks[b] for b in np.flatnonzero(chosen)])) if chosen.any() else np.zeros(0, int)

    def neighbours(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, distances) of the k nearest other points of each point, all if fewer."""
        x, n = self.x, len(self.x)
        k = min(k, n - 1)
        ids, out = np.zeros((n, k), int), np.zeros((n, k))
        if k < 1:
            return ids, out
        for b, own in enumerate(self.blocks):
            gap = self.gaps(self.low[b], self.high[b])
            first = np.argsort(gap, kind="stable")
            home = np.zeros(len(gap), bool)
            home[first[: 1 + int(np.searchsorted(np.cumsum(self.counts[first]), k + 1))]] = True
            bound = np.partition(between(x[own], x[self.points(home)]), k, 1)[:, k]
            for part in np.array_split(np.arange(len(own)), max(1, int((self.counts[gap <= bound.max()].sum() * len(own)) // STEP))):
                there = self.points(gap <= bound[part].max())
                d = between(x[own[part]], x[there])
                d[np.arange(len(part)), np.searchsorted(there, own[part])] = np.inf
                near = nearest(d, k)[:, :k]
                ids[own[part]], out[own[part]] = there[near], np.take_along_axis(d, near, 1)
        return ids, out

    def order_statistic(self, m: int) -> np.ndarray:
        """The distance number m (from 0, its own is one of them) of each point."""
        out = np.zeros(len(self.x))
        for b, own in enumerate(self.blocks):
            gap, span = self.gaps(self.low[b], self.high[b]), self.spans(self.low[b], self.high[b])
            up, down = np.argsort(span), np.argsort(gap)
            most = span[up][np.searchsorted(np.cumsum(self.counts[up]), m + 1)]
            least = gap[down][np.searchsorted(np.cumsum(self.counts[down]), m + 1)]
            sure = span < least
            d = between(self.x[own], self.x[self.points(~sure & (gap <= most))])
            at = m - int(self.counts[sure].sum())
            out[own] = np.partition(d, at, 1)[:, at]
        return out

    def window_sums(self, q: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) of the points within h of each row of q."""
        total, count = np.zeros((len(q), q.shape[1])), np.zeros(len(q))
        sums = np.array([self.x[b].sum(0) for b in self.blocks])
        asked = Plane(q, WINDOW_SIZE)
        for b, own in enumerate(asked.blocks):
            full = self.spans(asked.low[b], asked.high[b]) <= h
            there = self.points(~full & (self.gaps(asked.low[b], asked.high[b]) <= h))
            inside = (between(q[own], self.x[there]) <= h).astype(float)
            total[own], count[own] = inside @ self.x[there] + sums[full].sum(0), inside.sum(1) + self.counts[full].sum()
        return total, count

    def nearer(self, low: np.ndarray, high: np.ndarray, open_: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(least gap, positions of points) of the open blocks, from near to far, a few at a time."""
        gap = self.gaps(low, high)
        order = np.argsort(gap, kind="stable")
        order = order[open_[order]]
        for a in range(0, len(order), 16):
            chosen = np.zeros(len(gap), bool)
            chosen[order[a : a + 16]] = True
            yield float(gap[order[a]]), self.points(chosen)


def least_between(x: np.ndarray, labels: np.ndarray) -> float:
    """Least distance between points of different labels; inf where there is one label."""
    codes = np.unique(labels, return_inverse=True)[1]
    if len(x) < 2 or codes.max() == 0:
        return np.inf
    plane, least = Plane(x), np.inf
    pure = np.array([codes[b[0]] if (codes[b] == codes[b[0]]).all() else -1 for b in plane.blocks])
    for b, own in enumerate(plane.blocks):
        for gap, there in plane.nearer(plane.low[b], plane.high[b], (pure != pure[b]) | (pure < 0)):
            if gap >= least:
                break
            d = between(x[own], x[there])
            d[codes[own, None] == codes[None, there]] = np.inf
            least = min(least, float(d.min()))
    return least


def distance_sum(x: np.ndarray, rows: int = 256, columns: int = 2048) -> float:
    """Sum of the distances of all ordered pairs, each pair taken once."""
    total = 0.0
    for i in range(0, len(x), rows):
        own = x[i : i + rows]
        total += between(own, own).sum()
        for j in range(i + rows, len(x), columns):
            total += 2 * between(own, x[j : j + columns]).sum()
    return float(total)


def least_apart(x: np.ndarray, labels: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Least max(distance, core, core) from each label, ascending, to a point of another; inf where there is one label."""
    codes = np.unique(labels, return_inverse=True)[1]
    plane, least = Plane(x), np.full(codes.max() + 1, np.inf)
    pure = np.array([codes[b[0]] if (codes[b] == codes[b[0]]).all() else -1 for b in plane.blocks])
    for b, own in enumerate(plane.blocks):
        for gap, there in plane.nearer(plane.low[b], plane.high[b], (pure != pure[b]) | (pure < 0)):
            own = own[np.maximum(core[own], gap) < least[codes[own]]]
            if not len(own):
                break
            w = np.maximum(between(x[own], x[there]), np.maximum(core[own, None], core[None, there]))
            w[codes[own, None] == codes[None, there]] = np.inf
            np.minimum.at(least, codes[own], w.min(1))
    return least


def reachability(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(d, np.maximum(a, b))


def spanning_tree(x: np.ndarray, core: np.ndarray, weigh=reachability) -> list[tuple[float, int, int]]:
    """kernels.mst of weigh(distance, core, core), the distance or more and growing with the second core.

    Boruvka's rounds over listed neighbours, and over blocks where lists don't
    settle a part's lightest edge.
    """
    n = len(x)
    if n < 2:
        return []
    plane = Plane(x)
    ids, d = plane.neighbours(max(LISTED, 1))
    weight = weigh(d, core[:, None], core[ids])
    beyond = weigh(d[:, -1], core, np.zeros(n)) if ids.shape[1] < n - 1 else np.full(n, np.inf)
    at, comp, edges = np.arange(n), np.arange(n), []
    block_of = np.zeros(n, int)
    for b, own in enumerate(plane.blocks):
        block_of[own] = b

    def lightest(w: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, position) of the least of each row, equal ones by position."""
        least = w.min(1)
        return least, np.where(w == least[:, None], there, n).min(1)

    while True:
        parts = comp.max() + 1
        if parts == 1:
            return sorted(edges)
        w, j = lightest(np.where(comp[ids] != comp[:, None], weight, np.inf), ids)
        ok = np.isfinite(w)
        found = [(w[ok], at[ok], j[ok])]
        bound = np.full(parts, np.inf)
        np.minimum.at(bound, comp[ok], w[ok])
        np.minimum.at(bound, comp[j[ok]], w[ok])
        asks = np.flatnonzero(beyond <= bound[comp])
        pure = np.array([comp[b[0]] if (comp[b] == comp[b[0]]).all() else -1 for b in plane.blocks])
        asks = asks[np.argsort(block_of[asks], kind="stable")]
        for group in np.split(asks, np.flatnonzero(np.diff(block_of[asks])) + 1) if len(asks) else []:
            own = group[beyond[group] <= bound[comp[group]]]
            if not len(own):
                continue
            one = comp[own[0]] if (comp[own] == comp[own[0]]).all() else -1
            for gap, there in plane.nearer(x[own].min(0), x[own].max(0), (pure != one) | (pure < 0)):
                if gap > bound[comp[own]].max():
                    break
                there = there[comp[there] != one]
                if not len(there):
                    continue
                w = weigh(between(x[own], x[there]), core[own, None], core[None, there])
                w[comp[own, None] == comp[None, there]] = np.inf
                w, j = lightest(w, there)
                ok = w <= np.minimum(bound[comp[own]], 1e308)
                found.append((w[ok], own[ok], j[ok]))
                np.minimum.at(bound, comp[own[ok]], w[ok])
                np.minimum.at(bound, comp[j[ok]], w[ok])
        w, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        w, u, v = np.tile(w, 2), np.tile(np.minimum(a, b), 2), np.tile(np.maximum(a, b), 2)
        side = np.concatenate((comp[a], comp[b]))
        order = np.lexsort((v, u, w, side))
        order = order[np.unique(side[order], return_index=True)[1]]
        u, v, w, side = u[order], v[order], w[order], side[order]  # side: 0 to parts - 1
        edges += list({(float(e), int(p), int(q)) for e, p, q in zip(w, u, v, strict=True)})
        up = np.where(comp[u] == side, comp[v], comp[u])
        up = np.where((up[up] == np.arange(parts)) & (np.arange(parts) < up), np.arange(parts), up)
        while (up[up] != up).any():
            up = up[up]
        comp = np.unique(up[comp], return_inverse=True)[1]


def linked(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """kernels.dbscan of points of the plane over cells whose points are all within eps of each other."""
    cells, cell, counts = np.unique(np.floor(x / (eps / np.sqrt(2) * (1 - 1e-9))).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    cell = cell.ravel()
    members = np.split(np.argsort(cell, kind="stable"), np.cumsum(counts)[:-1])
    number = {c: i for i, c in enumerate(map(tuple, cells.tolist()))}
    offsets = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]
    around = lambda c: [m for i, j in offsets if (m := number.get((int(cells[c, 0]) + i, int(cells[c, 1]) + j))) is not None]

    def steps(own: np.ndarray, there: np.ndarray):
        size = max(1, STEP // max(1, len(there)))
        for a in range(0, len(own), size):
            yield own[a : a + size], between(x[own[a : a + size]], x[there]) <= eps

    core = counts[cell] >= least
    sparse = np.flatnonzero(counts < least)
    for c in sparse:
        for part, near in steps(members[c], np.concatenate([members[m] for m in around(c)])):
            core[part] = near.sum(1) >= least
    root = np.arange(len(cells))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def close(points: np.ndarray, others: np.ndarray) -> np.ndarray:
        low, high = x[others].min(0), x[others].max(0)
        return points[np.sqrt((np.maximum(0, np.maximum(low - x[points], x[points] - high)) ** 2).sum(1)) <= eps]

    cores = [m[core[m]] for m in members]
    for c in range(len(cells)):
        for m in around(c) if len(cores[c]) else ():
            if m > c and len(cores[m]) and find(c) != find(m):
                a = close(cores[c], cores[m])
                b = close(cores[m], a) if len(a) else a
                # A few points settle most pairs of cells.
                if len(b) and ((between(x[a[:64]], x[b[:64]]) <= eps).any() or any(near.any() for _, near in steps(a, b))):
                    root[find(m)] = find(c)
    labels = np.full(len(x), -1)
    at = np.flatnonzero(core)
    if not len(at):
        return labels
    top = np.array([find(c) for c in range(len(cells))])[cell[at]]
    _, first, which = np.unique(top, return_index=True, return_inverse=True)
    labels[at] = np.argsort(np.argsort(first))[which.ravel()]
    for c in sparse:
        edge = members[c][~core[members[c]]]
        there = np.concatenate([cores[m] for m in around(c)])
        if len(edge) and len(there):
            for part, near in steps(edge, there):
                joined = np.where(near, labels[there], len(x)).min(1)
                labels[part] = np.where(joined < len(x), joined, -1)
    return labels
