"""Pattern indices: shape descriptors of single clusters, in NumPy.

Each kernel scores the points of one cluster in [0, 1], or None where the
cluster has too few points for it. The index of a partition is the
size-weighted mean over the clusters that have a score; without any it is NULL
(the failed value of the protocol). parallel_bands looks at all clusters.
Clusters are centred first. Line fits are least-squares principal axes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contours import enclosing_circle, fit_ellipse, hull, polygon
from .indices import clustered
from .kernels import distances, in_blocks, mst
from .plane import Plane, spanning_tree
from .search import spread

EPS = 1e-12


@dataclass(frozen=True)
class Pattern:
    """A cluster kernel, its least number of points and the power of its squash to [0, 1]."""

    kernel: Callable[[np.ndarray], float]
    least: int
    power: float = 1.0


PATTERNS: dict[str, Pattern] = {}


def pattern(name: str, least: int, power: float = 1.0):
    def put(f):
        PATTERNS[name] = Pattern(f, least, power)
        return f

    return put


def principal(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates along the main axis and across it."""
    u = np.linalg.eigh(np.cov(z.T))[1][:, -1]
    return z @ u, z @ np.array([-u[1], u[0]])


def stretch(long: np.ndarray, short: np.ndarray, r0: float = 2.0) -> float:
    """1 - exp(-(ratio of spreads) / r0)."""
    return float(np.clip(1 - np.exp(-(np.std(long) / (np.std(short) + EPS)) / r0), 0, 1))


def shares(values: np.ndarray, bins: int, span=None) -> np.ndarray:
    h = np.histogram(values, bins, span)[0].astype(float)
    return h / max(h.sum(), EPS)


def peaks(h: np.ndarray, least: float, apart: int) -> np.ndarray:
    """Local maxima of at least a height; the higher of two that are too near stays."""
    inner = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] >= h[2:]) & (h[1:-1] >= least)) + 1
    kept: list[int] = []
    for i in inner[np.argsort(-h[inner], kind="stable")]:
        if all(abs(i - j) >= apart for j in kept):
            kept.append(int(i))
    return np.array(sorted(kept), int)


def neighbours(z: np.ndarray, k: int) -> np.ndarray:
    """The k nearest points of each point, which is one of them."""
    if in_blocks(z):
        return np.column_stack((np.arange(len(z)), Plane(z).neighbours(k - 1)[0]))
    return np.argsort(distances(z), 1, kind="stable")[:, :k]


@pattern("arc_circle_fit", 5)
def arc_circle_fit(z: np.ndarray) -> float | None:
    """CVI-15: evenness of the distances to the enclosing circle's centre, weighed by the axis ratio of the fitted ellipse."""
    r = np.sqrt(((z - enclosing_circle(z)[0]) ** 2).sum(1))
    if r.mean() <= EPS:
        return None
    fitted = fit_ellipse(z)
    ratio = fitted[2] / fitted[1] if fitted else 1.0
    return float(np.exp(-min(2.0, r.std() / r.mean())) * (0.6 + 0.4 * ratio))


@pattern("ladderness", 8, 0.5)
def ladderness(z: np.ndarray) -> float:
    """CVI-16: peaks of the smoothed histogram across the first axis."""
    e = stretch(z[:, 0], z[:, 1])
    h = np.histogram(z[:, 1], int(np.clip(np.sqrt(len(z)), 16, 96)))[0]
    h = np.convolve(h, np.array([1, 2, 3, 2, 1]) / 9, "same")
    top = peaks(h, 0.05 * h.max(), 2)
    if len(top) <= 1:
        return 0.25 * e
    return float((1 - np.exp(-len(top) / 3)) * (h[top] / h.max()).mean() * e)


@pattern("parabolicity", 5, 0.7)
def parabolicity(z: np.ndarray) -> float:
    """CVI-18: the better of two quadratic fits, times its curvature."""
    if (z.std(0) <= EPS).any():
        return 0.0
    s = (z - z.mean(0)) / z.std(0)
    fits = []
    for x, y in (s.T, s.T[::-1]):
        c = np.polyfit(x, y, 2)
        fits.append((float(np.clip(1 - ((y - np.polyval(c, x)) ** 2).sum() / ((y - y.mean()) ** 2).sum(), 0, 1)), abs(c[0])))
    r2, bend = max(fits, key=lambda f: f[0])
    return 0.0 if r2 < 0.2 else float(r2 * (1 - np.exp(-min(bend / 0.1, 5.0))))


@pattern("periodicity_1d", 8, 0.5)
def periodicity_1d(z: np.ndarray) -> float:
    """CVI-19: 0.7 of the strongest frequency's share in the histogram of the second axis, less its envelope, and 0.3 of the elongation."""
    n = int(np.clip(np.sqrt(len(z)), 16, 128))
    h = np.histogram(z[:, 1], n)[0].astype(float)
    wave = h - np.convolve(h, np.full(k := max(3, n // 8), 1 / k), "same")
    heights = np.abs(np.fft.rfft(wave))[1:]
    share = heights.max() / heights.sum() if (h > 0).sum() >= 8 and not np.allclose(wave, 0) else 0.0
    long = 1 - np.exp(-z[:, 0].std() / (z[:, 1].std() + EPS) / 2)
    return float(np.clip(0.7 * share + 0.3 * long, 0, 1))


@pattern("line_straightness", 3)
def line_straightness(z: np.ndarray) -> float:
    """CVI-20: share of the variance along the line, and thinness."""
    t, d = principal(z)
    total = t.var() + d.var()
    return float(0.5 * t.var() / total + 0.5 * np.exp(-d.std() / (t.std() + 1e-8))) if total > 0 else 0.0


def _segment_errors(x: np.ndarray, y: np.ndarray) -> Callable[[int, int], tuple[float, float]]:
    """(squared error, R2) of a line through the points i to j, from running sums."""
    sums = [np.concatenate(([0.0], np.cumsum(v))) for v in (x, y, x * x, x * y, y * y)]

    def of(i: int, j: int) -> tuple[float, float]:
        n = j - i
        sx, sy, sxx, sxy, syy = (s[j] - s[i] for s in sums)
        vx, vy, c = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        error = max(0.0, vy - c * c / vx) if vx > EPS else max(0.0, vy)
        return error, float(np.clip(1 - error / vy, 0, 1)) if vy > EPS else 0.0

    return of


def _cuts(i: int, j: int, least: int, most: int) -> np.ndarray:
    c = np.arange(i + least, j - least)
    return c if len(c) <= most else c[np.linspace(0, len(c) - 1, most).astype(int)]


@pattern("piecewise_linearity", 12)
def piecewise_linearity(z: np.ndarray, least: int = 6, most: int = 60, scale: float = 0.2, min_r2: float = 0.2, weight: float = 0.35) -> float:
    """CVI-21: what two or three line pieces gain over one."""
    x, y = z[np.argsort(z[:, 0], kind="stable")].T
    if x.std() <= EPS:
        return 0.0
    of, n = _segment_errors(x, y), len(x)
    one = of(0, n)[0]
    if one <= EPS:
        return 0.0

    def split(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
        best, kept = sum(of(*p)[0] for p in pieces), pieces
        for at, (i, j) in enumerate(pieces):
            for k in _cuts(i, j, least, most):
                tried = [*pieces[:at], (i, int(k)), (int(k), j), *pieces[at + 1 :]]
                if (error := sum(of(*p)[0] for p in tried)) < best:
                    best, kept = error, tried
        return kept

    pieces = split(split([(0, n)]))
    gain = max(0.0, (one - sum(of(*p)[0] for p in pieces)) / one) if len(pieces) > 1 else 0.0
    quality = min(1.0, min(of(*p)[1] for p in pieces) / min_r2)
    return float(np.clip(((1 - weight) * (1 - np.exp(-gain / scale)) + weight * stretch(z[:, 0], z[:, 1])) * quality, 0, 1))


@pattern("bimodality_anti_thickness", 20, 0.6)
def bimodality_anti_thickness(z: np.ndarray) -> float:
    """CVI-23: 0.7 of two peaks across the line (0.55 depth of the valley, 0.45 their distance in deviations) and 0.3 of the elongation."""
    t, d = principal(z)
    long = stretch(t, d)
    if d.std() <= EPS:
        return 0.3 * long
    h, edges = np.histogram((d - d.mean()) / d.std(), int(np.clip(np.sqrt(len(d)), 32, 128)))
    two = 0.0
    if np.count_nonzero(h) >= 10:
        h = np.convolve(h, np.array([1, 2, 3, 2, 1]) / 9, "same")
        inner = np.flatnonzero((h[1:-1] >= h[:-2]) & (h[1:-1] >= h[2:]) & (h[1:-1] >= 0.15 * h.max())) + 1
        inner = inner[np.argsort(-h[inner], kind="stable")]
        other = inner[np.abs(inner - inner[0]) >= 6] if len(inner) else inner
        if len(other):
            a, b = sorted((inner[0], other[0]))
            valley = (min(h[a], h[b]) - h[a : b + 1].min()) / max(h[a], h[b])
            two = 0.55 * valley + 0.45 * (1 - np.exp(-(edges[b] - edges[a])))
    return float(np.clip(0.7 * two + 0.3 * long, 0, 1))


def triangulation(z: np.ndarray) -> np.ndarray:
    """Delaunay triangles (m, 3) by inserting one point after the other (Bowyer and Watson)."""
    n = len(z)
    c, w = z.mean(0), 20 * max(np.ptp(z, 0).max(), EPS)
    p = np.vstack((z, c + np.array([[-w, -w], [w, -w], [0, w]])))
    # Triangles with the centres and squared radii of their circles, in slots: new ones take those of the ones that go.
    tri, centre, radius = np.zeros((2 * n + 8, 3), int), np.zeros((2, 2 * n + 8)), np.zeros(2 * n + 8)

    def circles(t):
        a, b, q = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        d = 2 * ((b - a)[:, 0] * (q - a)[:, 1] - (b - a)[:, 1] * (q - a)[:, 0])
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        bb, qq = ((b - a) ** 2).sum(1), ((q - a) ** 2).sum(1)
        ux, uy = ((q - a)[:, 1] * bb - (b - a)[:, 1] * qq) / d, ((b - a)[:, 0] * qq - (q - a)[:, 0] * bb) / d
        return a + np.stack((ux, uy), 1), (ux * ux + uy * uy) * (1 + 1e-12)

    def put(at: np.ndarray, t: np.ndarray) -> None:
        c, r = circles(t)
        tri[at], centre[:, at], radius[at] = t, c.T, r

    put(np.array([0]), np.array([[n, n + 1, n + 2]]))
    m = 1
    for i in np.random.default_rng(0).permutation(n):
        d, e = centre[0, :m] - p[i, 0], centre[1, :m] - p[i, 1]
        d *= d
        e *= e
        d += e
        hit = np.flatnonzero(d < radius[:m])
        edges = np.concatenate((tri[hit][:, [0, 1]], tri[hit][:, [1, 2]], tri[hit][:, [2, 0]]))
        ends = np.sort(edges, 1)
        _, first, times = np.unique(ends[:, 0] * (n + 3) + ends[:, 1], return_index=True, return_counts=True)
        rim = edges[first[times == 1]]
        left = hit[len(rim) :]  # more go than come only by rounding
        if len(rim):
            at = np.concatenate((hit[: len(rim)], np.arange(m, m + max(0, len(rim) - len(hit)))))
            m += max(0, len(rim) - len(hit))
            if m > len(radius):
                tri, centre, radius = np.pad(tri, ((0, m), (0, 0))), np.pad(centre, ((0, 0), (0, m))), np.pad(radius, (0, m))
            put(at, np.column_stack((rim, np.full(len(rim), i))))
        if len(left):
            tri[left], radius[left] = n, -1.0
    tri = tri[:m]
    return tri[(tri < n).all(1)]


#: The last cloud of alpha_shape() with its result, as several patterns ask for it.
_shape: tuple | None = None


def alpha_shape(z: np.ndarray, factor: float = 2.5) -> tuple[float, float]:
    """(area, perimeter) of the triangles with a circumradius of at most factor median neighbour distances."""
    global _shape
    if _shape is None or _shape[0] is not z or _shape[1] != factor:
        _shape = z, factor, _alpha_shape(z, factor)
    return _shape[2]


def _alpha_shape(z: np.ndarray, factor: float) -> tuple[float, float]:
    z = np.unique(z, axis=0)
    if len(z) < 4:
        return 0.0, 0.0
    tri = triangulation(z)
    sides = [np.sqrt(((z[tri[:, i]] - z[tri[:, j]]) ** 2).sum(1)) for i, j in ((0, 1), (1, 2), (2, 0))]
    u, v = z[tri[:, 1]] - z[tri[:, 0]], z[tri[:, 2]] - z[tri[:, 0]]
    area = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / 2
    near = Plane(z).neighbours(1)[1][:, 0] if in_blocks(z) else np.sort(distances(z), 1)[:, 1]
    keep = sides[0] * sides[1] * sides[2] / np.maximum(4 * area, EPS) <= factor * np.median(near) * 2
    edges = np.sort(np.concatenate((tri[keep][:, [0, 1]], tri[keep][:, [1, 2]], tri[keep][:, [2, 0]])), 1)
    if not len(edges):
        return 0.0, 0.0
    rim, times = np.unique(edges, axis=0, return_counts=True)
    rim = rim[times == 1]
    return float(area[keep].sum()), float(np.sqrt(((z[rim[:, 0]] - z[rim[:, 1]]) ** 2).sum(1)).sum())


@pattern("alpha_shape_compactness", 10, 0.5)
def alpha_shape_compactness(z: np.ndarray) -> float:
    """CVI-22: isoperimetric quotient of the alpha shape."""
    area, rim = alpha_shape(z)
    return float(np.clip(4 * np.pi * area / rim**2, 0, 1)) if rim > EPS else 0.0


@pattern("convexity_ratio", 10, 0.5)
def convexity_ratio(z: np.ndarray) -> float:
    """CVI-24: area of the alpha shape over that of the convex hull."""
    whole = polygon(hull(z))[0] if len(hull(z)) > 2 else 0.0
    return float(np.clip(alpha_shape(z)[0] / whole, 0, 1)) if whole > EPS else 0.0


@pattern("curvature_consistency", 18, 0.6)
def curvature_consistency(z: np.ndarray) -> float:
    """CVI-25: one sign and an even size of the turns along the first axis."""
    p = z[np.argsort(z[:, 0], kind="stable")]
    a, b = p[1:-1] - p[:-2], p[2:] - p[1:-1]
    la, lb = np.linalg.norm(a, axis=1) + EPS, np.linalg.norm(b, axis=1) + EPS
    turn = np.arccos(np.clip((a * b).sum(1) / (la * lb), -1, 1)) * np.sign(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    k = turn / ((la + lb) / 2)
    k = k[np.abs(k) > max(np.percentile(np.abs(k), 25), 1e-8)]
    if len(k) < 8:
        return 0.0
    one_way = np.clip((max((k > 0).mean(), (k < 0).mean()) - 0.5) / 0.5, 0, 1)
    even = np.exp(-np.abs(k).std() / (np.abs(k).mean() + EPS))
    return float(0.7 * (0.6 * one_way + 0.4 * even) + 0.3 * stretch(z[:, 0], z[:, 1]))


@pattern("turning_points_count", 18, 0.6)
def turning_points_count(z: np.ndarray) -> float:
    """CVI-26: changes of direction of the binned trajectory, above its noise."""
    x, n = z[:, 0], len(z)
    if np.ptp(x) <= EPS:
        return 0.0
    bins = int(np.clip(np.sqrt(n), 12, 64))
    at = np.minimum(((x - x.min()) / np.ptp(x) * bins).astype(int), bins - 1)
    own = [z[at == b, 1] for b in range(bins)]
    own = [v for v in own if len(v) >= max(3, n // (4 * bins))]
    if len(own) < 5:
        return 0.0
    steps = np.diff([v.mean() for v in own])
    signs = np.sign(steps[np.abs(steps) >= max(1e-6, 1.5 * np.median([v.std() for v in own]))])
    return float(0.7 * (1 - np.exp(-np.count_nonzero(np.diff(signs)) / 1.8)) + 0.3 * stretch(z[:, 0], z[:, 1]))


@pattern("direction_entropy", 18, 0.5)
def direction_entropy(z: np.ndarray) -> float:
    """CVI-27: axial spread of the longest steps to near neighbours."""
    k = min(6, len(z) - 1)
    near = neighbours(z, k + 1)[:, 1:]
    v = (z[near] - z[:, None, :]).reshape(-1, 2)
    size = np.linalg.norm(v, axis=1)
    v, size = v[size > 1e-8], size[size > 1e-8]
    if len(v) < 12:
        return 0.0
    top = np.argsort(-size, kind="stable")[: max(12, len(v) // 4)]
    w, a = size[top] / size[top].sum(), 2 * np.arctan2(v[top, 1], v[top, 0])
    spread = 1 - min(1.0, np.hypot((w * np.cos(a)).sum(), (w * np.sin(a)).sum()))
    return float(0.75 * spread + 0.25 * stretch(z[:, 0], z[:, 1]))


@pattern("gridness_2d", 40, 0.5)
def gridness_2d(z: np.ndarray, size: int = 32) -> float:
    """CVI-28: peaked and periodic rows and columns of the occupancy grid."""
    u = (z - z.min(0)) / np.maximum(np.ptp(z, 0), EPS)
    ij = np.minimum((u * size).astype(int), size - 1)
    occupied = np.zeros((size, size))
    occupied[ij[:, 1], ij[:, 0]] = 1
    total = 0.0
    for axis in (0, 1):
        s = occupied.sum(1 - axis)
        active = (s >= max(2.0, 1.6 * np.median(s) + 1)).astype(float)
        if active.sum() < 3:
            return 0.0
        f = np.abs(np.fft.rfft(active - active.mean()))[1:]
        total += (s.max() - s.mean()) / (s.max() + EPS) * (f.max() / f.sum() if f.sum() > EPS else 0.0)
    return float(total / 2)


@pattern("mst_smoothness", 20, 0.7)
def mst_smoothness(z: np.ndarray) -> float:
    """CVI-29: straight passages and few branches of the minimum spanning tree."""
    near: list[list[int]] = [[] for _ in z]
    for _, a, b in spanning_tree(z, np.zeros(len(z))) if in_blocks(z) else mst(distances(z)):
        near[a].append(b), near[b].append(a)
    straight = []
    for i, own in enumerate(near):
        if len(own) == 2:
            a, b = z[own[0]] - z[i], z[own[1]] - z[i]
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            if norm > EPS:
                straight.append(np.arccos(np.clip(a @ b / norm, -1, 1)) / np.pi)
    angle = float(np.mean(straight)) if len(straight) >= 3 else 0.0
    return 0.75 * angle + 0.25 * float(np.exp(-np.mean([max(0, len(own) - 2) for own in near])))


def _along(t: np.ndarray, bins: int) -> np.ndarray:
    return np.minimum(((t - t.min()) / max(np.ptp(t), EPS) * bins).astype(int), bins - 1)


@pattern("ribbon_thickness", 30, 0.7)
def ribbon_thickness(z: np.ndarray, bins: int = 20) -> float:
    """CVI-30: thin and even width along the main axis."""
    t, d = principal(z)
    at = _along(t, bins)
    own = [np.abs(d[at == b]) for b in range(bins) if (at == b).sum() >= 8]
    if len(own) < max(3, bins // 4):
        return 0.0
    w = np.array([np.percentile(v, 90) - np.percentile(v, 10) for v in own])
    return float(stretch(t, d) * (0.5 / (1 + w.mean()) + 0.5 * np.exp(-w.std() / (w.mean() + EPS))))


@pattern("axial_symmetry", 40)
def axial_symmetry(z: np.ndarray, bins: int = 16) -> float:
    """CVI-31: like medians on both sides of the main axis."""
    t, d = principal(z)
    at, gaps = _along(t, bins), []
    for b in range(bins):
        own = d[at == b]
        up, down = own[own >= 0], -own[own < 0]
        if len(own) >= 8 and len(up) >= 3 and len(down) >= 3:
            a, c = np.median(up), np.median(down)
            gaps.append(abs(a - c) / max(a + c, EPS))
    return float(np.exp(-3 * np.mean(gaps))) if len(gaps) >= max(3, bins // 4) else 0.0


@pattern("connectivity_components", 25, 0.6)
def connectivity_components(z: np.ndarray, k: int = 8) -> float:
    """CVI-32: one over the components of the symmetric kNN graph (the point itself is one of the k)."""
    near = neighbours(z, min(k, len(z)))
    label = np.arange(len(z))
    while True:
        low = np.minimum(label, label[near].min(1))
        np.minimum.at(low, near.ravel(), np.repeat(low, near.shape[1]))
        if (low == label).all():
            return 1.0 / len(np.unique(label))
        label = low


@pattern("corner_sharpness", 30)
def corner_sharpness(z: np.ndarray) -> float:
    """CVI-33: sharp and uneven angles of the convex hull."""
    p = hull(z)
    if len(p) < 4:
        return 0.0
    a, b = np.roll(p, 1, 0) - p, np.roll(p, -1, 0) - p
    angle = np.arccos(np.clip((a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) + EPS), -1, 1))
    return float(0.6 * (angle < np.deg2rad(130)).mean() + 0.4 * (1 - np.exp(-angle.std() / (angle.mean() + EPS))))


@pattern("hollow_score", 40, 0.5)
def hollow_score(z: np.ndarray, bins: int = 20) -> float:
    """CVI-35: an empty inside and a full ring."""
    r = np.linalg.norm(z - z.mean(0), axis=1)
    if r.max() <= EPS:
        return 0.0
    p = shares(r / r.max(), bins, (0, 1))
    inner, band = int(0.25 * bins), bins // 5
    best = max((p[s : s + band].sum() for s in range(inner, bins - band)), default=0.0)
    return float((1 - p[:inner].sum()) * best)


@pattern("radial_uniformity", 50, 0.5)
def radial_uniformity(z: np.ndarray, bins: int = 20) -> float:
    """CVI-36: inner mass times the entropy of the radial histogram."""
    r = np.linalg.norm(z - z.mean(0), axis=1)
    if r.max() <= EPS:
        return 0.0
    p = shares(r / r.max(), bins, (0, 1))
    own = p[p > 0]
    spread = -(own * np.log(own)).sum() / np.log(len(own)) if len(own) > 1 else 0.0
    return float(np.clip(p[: int(0.2 * bins)].sum() * spread, 0, 1))


def cluster_score(name: str, z: np.ndarray) -> float | None:
    """A pattern of the centred points of a cluster; None where they are too few or have none."""
    own = PATTERNS[name]
    s = own.kernel(z) if len(z) >= own.least else None
    return float(np.clip(s, 0, 1)) if s is not None and np.isfinite(s) else None


def partition_score(name: str, x: np.ndarray, labels: np.ndarray) -> float | None:
    """Size-weighted mean of a pattern over the clusters that have a score."""
    own = [x[labels == c] for c in np.unique(labels)]
    return weighted([(cluster_score(name, z - z.mean(0)), len(z)) for z in own])


def weighted(scores: Sequence[tuple[float | None, int]]) -> float | None:
    own = [(s, n) for s, n in scores if s is not None]
    return sum(n * s for s, n in own) / sum(n for _, n in own) if own else None


def band(z: np.ndarray) -> list[float] | None:
    """[direction, centre, weight] of a cluster that is like a line."""
    if len(z) < 8:
        return None
    values, vectors = np.linalg.eigh(np.cov(z.T))
    straight = values[-1] / max(values.sum(), EPS)
    return [*vectors[:, -1], *z.mean(0), len(z) * straight] if straight >= 0.6 else None


def parallel_bands(x: np.ndarray, labels: np.ndarray) -> float | None:
    """CVI-17: like directions and even offsets of two or more line-like clusters."""
    return bands([band(x[labels == c]) for c in np.unique(labels)])


def bands(found: Sequence[Sequence[float] | None]) -> float | None:
    """parallel_bands() of what band() tells of the clusters."""
    found = [list(f) for f in found if f is not None]
    if len(found) < 2:
        return None
    told = np.array(found)
    u, centre, w = told[:, :2], told[:, 2:4], told[:, 4]
    a = 2 * np.arctan2(u[:, 1], u[:, 0])
    angle = np.hypot(np.average(np.cos(a), weights=w), np.average(np.sin(a), weights=w))
    main = np.linalg.eigh((w[:, None, None] * u[:, :, None] * u[:, None, :]).sum(0))[1][:, -1]
    gaps = np.diff(np.sort(centre @ np.array([-main[1], main[0]])))
    gaps = gaps[gaps > EPS]
    spacing = 1 / (1 + gaps.std() / gaps.mean()) if len(gaps) >= 2 else 0.0
    return float(np.clip(0.5 * angle + 0.5 * spacing, 0, 1))


POWERS = {**{n: p.power for n, p in PATTERNS.items()}, "parallel_bands": 0.7}


def pattern_indices(points: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """(keys, metric_id, raw, norm) of the pattern indices of each partition; noise is left out.

    A task holds one cluster; partitions are put together from their scores.
    """
    chosen, own = list(names or POWERS), list(keys)
    kinds = "".join(f"{c} {points.schema[c].dataType.simpleString()}, " for c in own)
    kept = clustered(points).select(*own, "point_id", "x", "y", "label")

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        x = rows[["x", "y"]].to_numpy(float)
        z = x - x.mean(0)
        told = [{"metric_id": m, "score": None if m == "parallel_bands" else cluster_score(m, z), "band": band(x) if m == "parallel_bands" else None} for m in chosen]
        return pd.DataFrame(told).assign(**{k: rows[k].iloc[0] for k in own}, label=rows["label"].iloc[0], n=len(x)).astype({"score": "float64"})

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("label"), []
        for name in chosen:
            mine = rows[rows["metric_id"] == name]
            scores = [(None if np.isnan(s) else float(s), int(n)) for s, n in zip(mine["score"], mine["n"], strict=True)]
            raw = bands(mine["band"].tolist()) if name == "parallel_bands" else weighted(scores)
            norm = 0.0 if raw is None else float(np.clip(raw, 0, 1) ** POWERS[name])
            out.append({**{k: rows[k].iloc[0] for k in own}, "metric_id": name, "raw": raw, "norm": norm})
        return pd.DataFrame(out).astype({"raw": "float64"})

    kind = points.schema["label"].dataType.simpleString()
    scored = spread(kept, *own, "label").groupBy(*own, "label").applyInPandas(score, f"{kinds}label {kind}, n long, metric_id string, score double, band array<double>")
    return scored.groupBy(*(own or [F.lit(1).alias("_one")])).applyInPandas(together, f"{kinds}metric_id string, raw double, norm double")
