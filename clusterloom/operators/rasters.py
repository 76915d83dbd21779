"""Raster indices: shape descriptors of a cluster drawn as a small image, in NumPy.

A cluster is drawn into the box of all clustered points, so positions and sizes
are comparable. Image operations are written out here on arrays; they follow
the indices' definitions, not another library's rounding. Each kernel gives a
score in [0, 1]; the index of a partition is the size-weighted mean over the
clusters with enough points, else NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contours import fit_ellipse, fill, hull, largest_contour, least_rectangle, polygon, simplify_closed
from .indices import clustered
from .patterns import peaks

EPS = 1e-12
SIZE = 256


@dataclass(frozen=True)
class Raster:
    """A drawn cluster: point counts scaled to [0, 1] and smoothed, the filled mask, and the counts before smoothing."""

    gray: np.ndarray
    mask: np.ndarray
    raw: np.ndarray | None = None


@dataclass(frozen=True)
class RasterIndex:
    kernel: Callable[[Raster], float]
    least: int
    power: float = 1.0


RASTERS: dict[str, RasterIndex] = {}


def raster_index(name: str, least: int, power: float = 1.0):
    def put(f):
        RASTERS[name] = RasterIndex(f, least, power)
        return f

    return put


def shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a moved by whole pixels, zeros from outside."""
    out = np.zeros_like(a)
    h, w = a.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = a[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def dilate(m: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        rows = m | shifted(m, 1, 0) | shifted(m, -1, 0)
        m = rows | shifted(rows, 0, 1) | shifted(rows, 0, -1)
    return m


def erode(m: np.ndarray, times: int = 1) -> np.ndarray:
    return ~dilate(~m, times)


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(np.convolve, axis, a, k, "same")
    return a


def gradient(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gy, gx = np.gradient(a)
    return gx, gy, np.hypot(gx, gy)


def edges(mask: np.ndarray) -> np.ndarray:
    """Pixels of the mask that touch its outside."""
    return mask & ~erode(mask)


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels from 1 of the 8-connected parts (MF-12), by runs of rows and union-find."""
    labels, parent = np.zeros(mask.shape, int), [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(mask.shape[0]):
        row = mask[y]
        starts = np.flatnonzero(row & ~np.append(False, row[:-1]))
        ends = np.flatnonzero(row & ~np.append(row[1:], False)) + 1
        for a, z in zip(starts, ends, strict=True):
            above = np.unique(labels[y - 1, max(0, a - 1) : z + 1]) if y else np.array([0])
            own = sorted({find(int(i)) for i in above if i})
            if not own:
                parent.append(len(parent))
                own = [len(parent) - 1]
            for other in own[1:]:
                parent[other] = own[0]
            labels[y, a:z] = own[0]
    roots = np.array([find(i) for i in range(len(parent))])
    names = np.unique(roots[1:])
    place = np.zeros(len(parent), int)
    place[names] = np.arange(1, len(names) + 1)
    return place[roots][labels], len(names)


def sizes(mask: np.ndarray) -> np.ndarray:
    labels, n = components(mask)
    return np.bincount(labels.ravel(), minlength=n + 1)[1:]


def holes(mask: np.ndarray) -> np.ndarray:
    """Sizes of the parts of the background that do not reach the border."""
    labels, n = components(~mask)
    rim = np.unique(np.concatenate((labels[0], labels[-1], labels[:, 0], labels[:, -1])))
    count = np.bincount(labels.ravel(), minlength=n + 1)
    return np.array([count[i] for i in range(1, n + 1) if i not in rim])


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thinning in two alternating passes until nothing changes (Zhang and Suen)."""
    m = mask.copy()
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    for _ in range(SIZE):
        changed = False
        for first in (True, False):
            p = np.stack([shifted(m, -dy, -dx) for dy, dx in ring])
            count = p.sum(0)
            turns = (~p & np.roll(p, -1, 0)).sum(0)
            a, b = ((p[0] & p[2] & p[4]), (p[2] & p[4] & p[6])) if first else ((p[0] & p[2] & p[6]), (p[0] & p[4] & p[6]))
            drop = m & (count >= 2) & (count <= 6) & (turns == 1) & ~a & ~b
            changed |= bool(drop.any())
            m = m & ~drop
        if not changed:
            break
    return m


def depth(mask: np.ndarray) -> np.ndarray:
    """Steps of erosion that each pixel survives."""
    out, m = np.zeros(mask.shape), mask
    while m.any():
        out += m
        m = erode(m)
    return out


def box_slope(mask: np.ndarray) -> float:
    """Box-counting dimension (MF-13)."""
    scales, counts = (2, 4, 8, 16, 32), []
    for s in scales:
        counts.append(max(1, mask[: SIZE // s * s, : SIZE // s * s].reshape(SIZE // s, s, SIZE // s, s).any((1, 3)).sum()))
    return float(-np.polyfit(np.log(scales), np.log(counts), 1)[0])


def draw(z: np.ndarray, box: tuple[float, float, float, float], size: int = SIZE) -> Raster:
    """The points in the box (x0, x1, y0, y1), y upwards."""
    x0, x1, y0, y1 = box
    px = np.clip((z[:, 0] - x0) / max(x1 - x0, 1e-9) * (size - 1), 0, size - 1).astype(int)
    py = np.clip((1 - (z[:, 1] - y0) / max(y1 - y0, 1e-9)) * (size - 1), 0, size - 1).astype(int)
    count = np.zeros((size, size))
    np.add.at(count, (py, px), 1)
    return Raster(blur(count / count.max(), 1.0), erode(dilate(count > 0, 3)), count / count.max())


def _coords(m: np.ndarray) -> np.ndarray:
    return np.argwhere(m).astype(float)


def _largest(m: np.ndarray) -> np.ndarray:
    labels, n = components(m)
    return labels == 1 + np.argmax(np.bincount(labels.ravel(), minlength=n + 1)[1:]) if n else m


def _hough(points: np.ndarray, angles: int = 90) -> np.ndarray:
    """Votes by (angle, offset) of the lines through edge pixels."""
    a = np.arange(angles) * np.pi / angles
    rho = np.round(points @ np.stack((np.sin(a), np.cos(a)))).astype(int) + 2 * SIZE
    return np.stack([np.bincount(rho[:, i], minlength=4 * SIZE) for i in range(angles)])


def _segments(points: np.ndarray, votes: int, least: float, gap: float, tries: int = 64) -> np.ndarray:
    """Lengths of straight runs of edge pixels, strongest lines first; the pixels of a run are used up."""
    angle, found, left = np.arange(180) * np.pi / 180, [], points
    for _ in range(tries):
        if len(left) < votes:
            break
        rho = np.round(left @ np.stack((np.sin(angle), np.cos(angle)))).astype(int) + 2 * SIZE
        count = np.stack([np.bincount(rho[:, i], minlength=4 * SIZE) for i in range(180)])
        i, offset = np.unravel_index(count.argmax(), count.shape)
        if count[i, offset] < votes:
            break
        on = np.flatnonzero(np.abs(rho[:, i] - offset) <= 1)
        t = left[on] @ np.array((np.cos(angle[i]), -np.sin(angle[i])))
        order = np.argsort(t)
        runs = np.split(order, np.flatnonzero(np.diff(t[order]) > gap) + 1)
        found += [float(np.ptp(t[run])) for run in runs if np.ptp(t[run]) >= least]
        left = np.delete(left, on, 0)
    return np.array(found)


@raster_index("hough_line_strength", 30, 0.6)
def hough_line_strength(r: Raster) -> float:
    """CVI-37: length of the straight runs of 30 pixels or more over the number of edge pixels."""
    e = _coords(edges(r.mask))
    return float(min(1.0, _segments(e, 50, 30, 5).sum() / len(e))) if len(e) else 0.0


@raster_index("peak_to_background_hough", 30, 0.7)
def peak_to_background_hough(r: Raster) -> float:
    """CVI-38: (longest run - mean of the shorter ones) over their sum; 1 for a single run."""
    e = _coords(edges(r.mask))
    runs = _segments(e, 40, round(0.12 * SIZE), round(0.03 * SIZE)) if len(e) >= 10 else np.zeros(0)
    if len(runs) < 2:
        return float(len(runs))
    peak = runs.max()
    rest = runs[runs < peak - 1e-6]
    back = rest.mean() if len(rest) else runs.mean()
    return float((peak - back) / (peak + back + 1e-9))


def _strong(size: np.ndarray, least: int) -> np.ndarray | None:
    """Pixels whose gradient is above the 60% quantile; None where there are fewer than least."""
    found = size > max(float(np.quantile(size, 0.6)), EPS)
    return found if found.sum() >= least else None


@raster_index("orientation_histogram_entropy", 40, 0.4)
def orientation_histogram_entropy(r: Raster) -> float:
    """CVI-39: length of the mean of the doubled gradient angles, weighted by gradient size."""
    gx, gy, size = gradient(blur(r.mask.astype(float), 0.8))
    at = _strong(size, 20)
    if at is None:
        return 0.0
    turned = (gx[at] + 1j * gy[at]) ** 2 / np.maximum(size[at] ** 2, EPS)
    return float(min(1.0, abs((size[at] * turned).sum()) / size[at].sum()))


@raster_index("edge_coherence", 50, 0.5)
def edge_coherence(r: Raster) -> float:
    """CVI-40: (l1 - l2) / (l1 + l2) of the structure tensor summed over strong gradients."""
    gx, gy, size = gradient(blur(r.mask.astype(float), 0.8))
    at = _strong(size, 30)
    if at is None:
        return 0.0
    a, b, c = (blur(v, 1.2)[at].sum() for v in (gx * gx, gx * gy, gy * gy))
    return float(np.clip(np.hypot(a - c, 2 * b) / max(a + c, 1e-9), 0, 1))


def density_image(r: Raster, binary: bool = False, weights: Sequence[int] = (1, 2, 1), wider: int = 1) -> np.ndarray:
    """Point counts (or occupied pixels) as whole gray values to 255, smoothed by the weights and widened by some pixels."""
    raw = r.mask.astype(float) if r.raw is None else r.raw
    g = 255.0 * (raw > 0) if binary else np.floor(255 * raw / max(raw.max(), EPS))
    half = len(weights) // 2
    for dy, dx in ((1, 0), (0, 1)):
        g = sum(w * shifted(g, (k - half) * dy, (k - half) * dx) for k, w in enumerate(weights)) / sum(weights)
    g = np.rint(g)
    for _ in range(wider):
        g = np.max([shifted(g, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    return g


def canny(g: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges of a gray image (Canny): ridges of the gradient above low that hang together with one above high."""
    gx, gy = _derivative(g, (1, 2, 1), (-1, 0, 1)), _derivative(g, (-1, 0, 1), (1, 2, 1))
    size = np.abs(gx) + np.abs(gy)
    flat, steep = np.abs(gy) <= np.abs(gx) * np.tan(np.pi / 8), np.abs(gy) > np.abs(gx) * np.tan(3 * np.pi / 8)
    before, after = np.zeros_like(size), np.zeros_like(size)
    for at, (dy, dx) in ((flat, (0, 1)), (steep, (1, 0)), (~flat & ~steep & (gx * gy > 0), (1, 1)), (~flat & ~steep & (gx * gy <= 0), (1, -1))):
        before[at], after[at] = shifted(size, dy, dx)[at], shifted(size, -dy, -dx)[at]
    ridge = (size > low) & (size > before) & (size >= after)
    labels, n = components(ridge)
    strong = np.zeros(n + 1, bool)
    strong[labels[ridge & (size > high)]] = True
    strong[0] = False
    return strong[labels]


def _derivative(g: np.ndarray, along_y: Sequence[int], along_x: Sequence[int]) -> np.ndarray:
    """Weighted sums over three rows and three columns, borders repeated inwards."""
    for axis, weights in ((0, along_y), (1, along_x)):
        wide = np.pad(g, [(1, 1) if i == axis else (0, 0) for i in range(2)], mode="reflect")
        g = sum(w * np.take(wide, range(k, k + g.shape[axis]), axis) for k, w in enumerate(weights))
    return g


def near(mask: np.ndarray, r: int) -> np.ndarray:
    """Pixels within r of the mask."""
    return np.any([shifted(mask, dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r + 1], axis=0)


def least_squares_circle(p: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Centre and radius of the circle of least algebraic distance (FN-23)."""
    if len(p) < 6:
        return None
    c = np.linalg.lstsq(np.column_stack((2 * p, np.ones(len(p)))), (p * p).sum(1), rcond=None)[0]
    square = c[2] + c[:2] @ c[:2]
    return (c[:2], float(np.sqrt(square))) if square > EPS else None


def voted_circles(g: np.ndarray, edge: np.ndarray, least: int, most: int, apart: float, votes: int = 22, cell: float = 1.2, wanted: int = 8) -> list[tuple[np.ndarray, float]]:
    """Circles by gradient voting: each edge pixel votes for the centres along its gradient, each centre takes its commonest distance."""
    b = blur(g, 1.2)
    gx, gy = _derivative(b, (1, 2, 1), (-1, 0, 1))[edge], _derivative(b, (-1, 0, 1), (1, 2, 1))[edge]
    size = np.hypot(gx, gy)
    at, way = _coords(edge)[size > EPS], np.stack((gy, gx), 1)[size > EPS] / size[size > EPS][:, None]
    n = int(np.ceil(SIZE / cell))
    steps = np.concatenate([np.arange(least, most + 1), -np.arange(least, most + 1)])
    spots = np.floor((at[:, None, :] + steps[None, :, None] * way[:, None, :]) / cell).astype(int).reshape(-1, 2)
    spots = spots[((spots >= 0) & (spots < n)).all(1)]
    count = np.bincount(spots[:, 0] * n + spots[:, 1], minlength=n * n).reshape(n, n)
    around = np.max([shifted(count, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    tops = np.argwhere((count == around) & (count > votes))
    found: list[tuple[np.ndarray, float]] = []
    for top in tops[np.argsort(-count[tuple(tops.T)], kind="stable")]:
        c = (top + 0.5) * cell
        if len(found) < wanted and all(np.hypot(*(c - other)) >= apart for other, _ in found):
            d = np.rint(np.hypot(*(at - c).T)).astype(int)
            d = d[(d >= least) & (d <= most)]
            if len(d):
                found.append((c, float(np.bincount(d).argmax())))
    return found


@raster_index("hough_arc_circle_strength", 60, 0.4)
def hough_arc_circle_strength(r: Raster) -> float:
    """CVI-41: the best circle's rim on edges, points on rim, covered angles and edge support; circles are voted or fitted."""
    g = density_image(r, weights=(1, 4, 6, 4, 1), wider=2)
    middle = float(np.median(g))
    e = canny(g, int(0.67 * middle), int(1.33 * middle)) if middle >= 1 else canny(g, 50, 150)
    at = _coords(e)
    if len(at) < 25:
        return 0.0
    raw = r.mask.astype(float) if r.raw is None else r.raw
    points, weight = _coords(raw > 0), raw[raw > 0]
    circles = voted_circles(g, canny(g, 70, 140), round(0.08 * SIZE), round(0.55 * SIZE), 0.3 * SIZE)
    fitted = least_squares_circle(np.repeat(points, np.maximum(1, np.rint(weight / weight.min())).astype(int), 0))
    wide, best = near(e, 2), 0.0
    turns = np.arange(240) * 2 * np.pi / 240
    for c, radius in [*circles, *([fitted] if fitted else [])]:
        rim = np.rint(c + radius * np.column_stack((np.sin(turns), np.cos(turns)))).astype(int)
        rim = rim[((rim >= 0) & (rim < SIZE)).all(1)]
        if radius <= 2 or not len(rim):
            continue
        on = np.abs(np.hypot(*(at - c).T) - radius) <= 2
        angle = np.arctan2(*(at[on] - c).T)
        cover = len(np.unique(np.minimum(((angle + np.pi) / (2 * np.pi) * 36).astype(int), 35))) / 36
        own = weight[np.abs(np.hypot(*(points - c).T) - radius) <= 2].sum() / weight.sum()
        if own >= 0.12 and cover >= 0.08 and on.mean() >= 0.01:
            best = max(best, float(np.sqrt(wide[tuple(rim.T)].mean() * own * cover) * (0.5 + 0.5 * on.mean())))
    return min(1.0, best)


@raster_index("convexity_ratio_image_based", 60)
def solidity(r: Raster) -> float:
    """CVI-42: area over the hull's."""
    m = _largest(r.mask)
    h = hull(_coords(m))
    return float(np.clip(m.sum() / max(polygon(h)[0] + polygon(h)[1] / 2 + 1, 1), 0, 1)) if len(h) > 2 else 0.0


def _moments(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = _coords(m)
    values, vectors = np.linalg.eigh(np.cov(p.T) + EPS * np.eye(2))
    return p.mean(0), values, vectors


def _outline(r: Raster) -> np.ndarray | None:
    """The traced border of the part with the largest area."""
    return largest_contour(*components(r.mask))


@raster_index("ellipse_fit_score", 80)
def ellipse_fit_score(r: Raster) -> float:
    """CVI-43: share of the least-squares ellipse's rim that lies within 2 pixels of an edge."""
    p, e = _outline(r), canny(density_image(r, binary=True), 60, 160)
    fitted = fit_ellipse(p) if p is not None else None
    if fitted is None or e.sum() < 30 or 2 * fitted[2] <= 1:
        return 0.0
    c, major, minor, turn = fitted
    t = np.arange(0, 360, 2) * np.pi / 180
    own = np.column_stack((major * np.cos(t), minor * np.sin(t))) @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
    rim = np.rint(c + own).astype(int)
    rim = rim[((rim >= 0) & (rim < r.mask.shape[0])).all(1)]
    return float(near(e, 2)[tuple(rim.T)].mean()) if len(rim) else 0.0


@raster_index("circularity_compactness", 60, 0.5)
def circularity_compactness(r: Raster) -> float:
    """CVI-44: 4 pi area over the squared length of the outline."""
    p = _outline(r)
    if p is None:
        return 0.0
    area, length = polygon(p)
    return float(np.clip(4 * np.pi * area / (length**2 + 1e-9), 0, 1))


@raster_index("polygonality", 120)
def polygonality(r: Raster) -> float:
    """CVI-45: overlap of the outline with its simplification within 2% of its length, times the simplicity of that."""
    p = _outline(r)
    if p is None:
        return 0.0
    corners = simplify_closed(p, 0.02 * polygon(p)[1])
    if len(corners) < 3:
        return 0.0
    a, b = fill(r.mask.shape, p), fill(r.mask.shape, corners)
    return float((a & b).sum() / ((a | b).sum() + 1e-9) * (1 - (min(len(corners), 12) - 3) / 9))


@raster_index("rectangularity", 80)
def rectangularity(r: Raster) -> float:
    """CVI-46: area of the outline over that of the smallest rectangle around it."""
    p = _outline(r)
    if p is None:
        return 0.0
    along, across = least_rectangle(p)
    return float(np.clip(polygon(p)[0] / (along * across + 1e-9), 0, 1)) if along * across > 0 else 0.0


@raster_index("morphological_band_count", 80, 0.6)
def morphological_band_count(r: Raster) -> float:
    """CVI-47: number, regularity and height of the bands that remain of the shape, turned level, after an opening by a line of 31 pixels."""
    p = _coords(r.mask)
    if len(p) < 20:
        return 0.0
    across, along = (p - p.mean(0)) @ _moments(r.mask)[2][:, 0], (p - p.mean(0)) @ _moments(r.mask)[2][:, 1]
    level = np.zeros((2 * SIZE, 2 * SIZE), bool)
    level[np.floor(across).astype(int) + SIZE, np.floor(along).astype(int) + SIZE] = True
    level = level | (np.roll(level, 1, 1) & np.roll(level, -1, 1))  # pixels that turning left out
    width = np.zeros(2 * SIZE)
    for y in np.flatnonzero(level.any(1)):
        ends = np.flatnonzero(np.diff(np.concatenate(([0], level[y].astype(int), [0]))))
        runs = ends[1::2] - ends[::2]
        width[y] = runs[runs >= 31].sum()
    if width.max() <= 0:
        return 0.0
    h = np.convolve(width / width.max(), np.ones(11) / 11, "same")
    top = [i for i in peaks(h, 0.0, 10) if h[i] - h[max(0, i - 10) : i + 11].min() >= 0.06]
    if len(top) < 2:
        return 0.0
    gaps = np.diff(top)
    return float((1 - np.exp(-0.35 * len(top))) / (1 + gaps.std() / gaps.mean()) * h[top].mean())


def _crossings(s: np.ndarray) -> tuple[int, int]:
    """(ends, junctions) of a skeleton."""
    near = sum(shifted(s.astype(int), dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - s
    return int((s & (near == 1)).sum()), int((s & (near >= 3)).sum())


@raster_index("skeleton_connectivity", 80, 0.3)
def skeleton_connectivity(r: Raster) -> float:
    """CVI-48: one part, few ends and junctions, and a dense skeleton in its box."""
    s = skeleton(r.mask)
    if not s.any():
        return 0.0
    ends, junctions = _crossings(s)
    filled = s.sum() / np.prod(np.ptp(np.argwhere(s), axis=0) + 1)
    return float(np.exp(-0.4 * (len(sizes(s)) - 1) - 0.005 * max(0, ends - 2) - 0.01 * junctions) * (1 - np.exp(-8 * filled)))


@raster_index("contour_graph_connectivity", 80, 0.5)
def contour_graph_connectivity(r: Raster) -> float:
    """CVI-49: share of the largest closed edge part, less for more parts of half a percent of the image."""
    e = edges(r.mask)
    if e.sum() < 40:
        return 0.0
    n = sizes(erode(dilate(e, 2), 2))
    large = n[n >= max(8, int(0.005 * e.size))]
    return float(np.exp(-0.05 * (len(large) - 1)) * large.max() / n.sum()) if len(large) else 0.0


def ridge_response(g: np.ndarray, sigmas: Sequence[float] = (1.0, 1.6, 2.4, 3.4), beta: float = 0.5, c: float = 15.0) -> np.ndarray:
    """Largest response over the scales of a bright line: from the eigenvalues of the Hessian, the larger in size below 0."""
    best, smooth, second, first = np.zeros_like(g), (1, 2, 1), (1, -2, 1), (-1, 0, 1)
    for sigma in sigmas:
        b = blur(g / max(1.0, g.max()), sigma)
        xx, yy, xy = (sigma**2 * _derivative(b, *w) for w in ((smooth, second), (second, smooth), (first, first)))
        half, part = (xx + yy) / 2, np.sqrt(np.maximum(0, ((xx + yy) / 2) ** 2 - (xx * yy - xy * xy)))
        a, z = half - part, half + part
        small, large = np.where(np.abs(a) > np.abs(z), z, a), np.where(np.abs(a) > np.abs(z), a, z)
        blob = (np.abs(small) / (np.abs(large) + 1e-9)) ** 2
        value = np.exp(-blob / (2 * beta**2)) * (1 - np.exp(-(small**2 + large**2) / (2 * c**2)))
        best = np.maximum(best, np.where(large < 0, value, 0))
    return np.clip(best, 0, 1)


@raster_index("ridge_strength", 80, 0.6)
def ridge_strength(r: Raster) -> float:
    """CVI-50: pixels with a quarter of the strongest ridge response or more, for each occupied one, saturating."""
    g = density_image(r)
    best, on = ridge_response(g), int((g > 0).sum())
    if on < 30 or best.max() <= 0:
        return 0.0
    return float(np.clip(1 - np.exp(-(best >= 0.25 * best.max()).sum() / on / 0.045), 0, 1))


@raster_index("thickness_uniformity", 120, 0.7)
def thickness_uniformity(r: Raster) -> float:
    """CVI-51: even depth along the skeleton."""
    s = skeleton(r.mask)
    t = 2 * depth(r.mask)[s]
    return float(1 / (1 + t.std() / t.mean())) if len(t) >= 5 and t.mean() > EPS else 0.0


@raster_index("glcm_haralick", 120, 0.5)
def glcm_haralick(r: Raster) -> float:
    """CVI-52: homogeneity times the root of the energy of co-occurring gray levels, times what their contrast leaves (MF-15)."""
    levels = 16
    if r.gray.max() <= EPS:
        return 0.0
    level = np.minimum((r.gray / r.gray.max() * levels).astype(int), levels - 1)
    i, j = np.indices((levels, levels))
    found = []
    for dx, dy in ((1, 0), (0, 1), (2, 0), (0, 2)):
        a, b = level[: level.shape[0] - dy, : level.shape[1] - dx].ravel(), level[dy:, dx:].ravel()
        p = np.bincount(a * levels + b, minlength=levels**2).reshape(levels, levels).astype(float)
        p = (p + p.T) / (2 * len(a))
        found.append(((p * (i - j) ** 2).sum(), (p / (1 + np.abs(i - j))).sum(), (p * p).sum()))
    contrast, alike, energy = np.mean(found, axis=0)
    return float(np.exp(-contrast / (0.35 * (levels - 1) ** 2)) * np.clip(alike, 0, 1) * np.clip(np.sqrt(energy), 0, 1))


def _patterns8(g: np.ndarray) -> np.ndarray:
    ring = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
    return sum((shifted(g, -dy, -dx) >= g).astype(int) << k for k, (dy, dx) in enumerate(ring))


@raster_index("lbp_stationarity", 150, 0.7)
def lbp_stationarity(r: Raster, tiles: int = 4) -> float:
    """CVI-53: nearness of the tiles' local binary patterns to their mean by half the chi-square distance (MF-16)."""
    gray = np.floor(255 * r.gray / r.gray.max()) if r.gray.max() > EPS else r.gray
    if (gray > 0).mean() < 0.02:
        return 0.0
    code = _patterns8(gray)[1:-1, 1:-1]
    cuts = [np.round(np.arange(tiles + 1) * n / tiles).astype(int) for n in code.shape]
    parts = [code[a:b, c:d] for a, b in zip(cuts[0], cuts[0][1:], strict=False) for c, d in zip(cuts[1], cuts[1][1:], strict=False)]
    h = np.array([np.bincount(x.ravel(), minlength=256) / x.size for x in parts if x.size >= 100])
    if len(h) < 2:
        return 0.0
    mean = h.mean(0)
    return float(1 / (1 + 6 * 0.5 * ((h - mean) ** 2 / (h + mean + EPS)).sum(1).mean()))


@raster_index("fractal_dimension", 120, 0.6)
def fractal_dimension(r: Raster) -> float:
    """CVI-54: 1 for a smooth outline, 0 for a filled plane and for fewer than 40 edge pixels."""
    e = edges(r.mask)
    return float(np.clip(2 - box_slope(e), 0, 1)) if e.sum() >= 40 else 0.0


def _strongest(a: np.ndarray, n: int, apart: int, least: float) -> np.ndarray:
    """(dy, dx, value) of the strongest places from the centre, none within a square of half side apart of the centre or another."""
    a, c, out = a.copy(), np.array(a.shape) // 2, []
    blank = lambda y, x: a[max(0, y - apart) : y + apart + 1, max(0, x - apart) : x + apart + 1].fill(0)
    blank(*c)
    for _ in range(n):
        y, x = np.unravel_index(a.argmax(), a.shape)
        if a[y, x] < max(least, EPS):
            break
        out.append((y - c[0], x - c[1], a[y, x]))
        blank(int(y), int(x))
    return np.array(out, float).reshape(-1, 3)


def grid_score(peaks: np.ndarray, tolerance: float = 25.0) -> float:
    """Strength of autocorrelation peaks in opposite pairs, more where the two strongest pairs cross at a right angle."""
    if len(peaks) < 2:
        return 0.0
    way = peaks[:, :2] / np.hypot(peaks[:, 0], peaks[:, 1])[:, None]
    facing = np.where(-way[:6] @ way.T > 0.65, peaks[None, :, 2], 0).max(1)
    strength = np.minimum(peaks[:6, 2], facing)
    paired = np.flatnonzero(strength > 0)
    if len(paired) < 2:
        return float(np.clip(0.6 * peaks[:, 2].mean(), 0, 1))
    angle = np.degrees(np.arctan2(peaks[paired, 0], peaks[paired, 1])) % 180
    one, two = np.argsort(-strength[paired], kind="stable")[:2]
    gap = abs(angle[one] - angle[two])
    right = np.exp(-((min(gap, 180 - gap) - 90) ** 2) / (2 * tolerance**2))
    return float(np.clip(strength[paired].mean(), 0, 1) * (0.6 + 0.4 * right))


@raster_index("gridness_fft_acf", 150, 0.5)
def gridness_fft_acf(r: Raster) -> float:
    """CVI-55: the ten strongest peaks of the autocorrelation apart from its centre and from each other, as a grid."""
    g = density_image(r)
    if g.max() <= 0:
        return 0.0
    g = g / g.max()
    acf = np.fft.fftshift(np.fft.ifft2(np.abs(np.fft.fft2(g - g.mean())) ** 2).real)
    acf -= acf.min()
    return grid_score(_strongest(acf / acf.max(), 10, 10, 0.12)) if acf.max() > EPS else 0.0


@raster_index("symmetry_score", 120, 0.45)
def symmetry_score(r: Raster) -> float:
    """CVI-56: the better of the likenesses of the image and its two mirror images."""
    g = r.gray / max(r.gray.max(), EPS)
    like = lambda m: 1 - np.abs(g - m).mean() / (g.mean() + 1e-9)
    return float(np.clip(max(like(g[::-1]), like(g[:, ::-1])), 0, 1)) if g.any() else 0.0


def _closed(mask: np.ndarray) -> np.ndarray:
    """Gaps of up to some 12 pixels filled: two dilations and two erosions by a disc of 7 pixels."""
    return _disc(_disc(mask, 2), 2, outside=True)


def _disc(mask: np.ndarray, times: int, outside: bool = False) -> np.ndarray:
    """Dilation by a disc of 7 pixels; of the outside: an erosion."""
    m = ~mask if outside else mask
    steps = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= 10]
    for _ in range(times):
        m = np.any([shifted(m, dy, dx) for dy, dx in steps], axis=0)
    return ~m if outside else m


@raster_index("euler_holes_count", 150, 0.5)
def euler_holes_count(r: Raster) -> float:
    """CVI-57: saturating in the number of real holes, less for more than two; 0 without any."""
    m = _closed(r.mask)
    n = int((holes(m) >= max(8.0, 0.0008 * m.size)).sum())
    return float((1 - np.exp(-1.5 * n)) / (1 + 0.15 * max(0, n - 2)))


@raster_index("connected_components_count", 120, 0.4)
def connected_components_count(r: Raster) -> float:
    """CVI-58: decay by the number of parts of the closed shape with 1% of it or more."""
    m = _closed(r.mask)
    if m.sum() < 60:
        return 0.0
    n = int((sizes(m) >= max(20, int(0.01 * m.sum()))).sum())
    return float(np.exp(-0.85 * (n - 1))) if n else 0.0


@raster_index("blobness_log_dog", 80, 0.5)
def blobness_log_dog(r: Raster) -> float:
    """CVI-59: the strongest 3% of the differences of Gaussians over their median, on occupied pixels, saturating."""
    raw = r.gray if r.raw is None else r.raw
    on = raw > 0
    if on.sum() < 20:
        return 0.0
    best = np.max([np.abs(blur(raw, sigma) - blur(raw, 1.6 * sigma)) for sigma in (1.2, 2.0, 3.2)], axis=0)[on]
    if best.sum() <= EPS:
        return 0.0
    top = np.sort(best)[-max(1, round(0.03 * len(best))) :].mean() / max(np.median(best), EPS)
    return float(max(0.0, 1 - np.exp(-(top - 1) / 3)) * (1 - np.exp(-on.sum() / 200)))


@raster_index("corner_junction_density", 80, 0.6)
def corner_junction_density(r: Raster) -> float:
    """CVI-60: corners (peaks of the least eigenvalue, 6 pixels apart, 120 at most) for each edge pixel, saturating."""
    e = edges(r.mask)
    if e.sum() < 25:
        return 0.0
    gx, gy, _ = gradient(e.astype(float))
    a, b, c = (sum(shifted(v, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) for v in (gx * gx, gx * gy, gy * gy))
    low = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    around = np.max([shifted(low, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    found = np.argwhere((low == around) & (low >= 0.01 * low.max()) & (low > EPS))
    kept: list[np.ndarray] = []
    for at in found[np.argsort(-low[tuple(found.T)], kind="stable")]:
        if len(kept) < 120 and all(((at - other) ** 2).sum() >= 36 for other in kept):
            kept.append(at)
    n = len(kept)
    return float(1 - np.exp(-n / e.sum() / 0.015))


def raster_indices(points: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """(keys, metric_id, raw, norm) of the raster indices of each partition; a task draws one partition's clusters."""
    chosen, own = list(names or RASTERS), list(keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, labels = rows[["x", "y"]].to_numpy(float), rows["label"].to_numpy()
        box = (x[:, 0].min(), x[:, 0].max(), x[:, 1].min(), x[:, 1].max())
        drawn = [(int((labels == c).sum()), draw(x[labels == c], box)) for c in np.unique(labels)]
        out = []
        for name in chosen:
            index = RASTERS[name]
            scored = [(n, float(np.clip(index.kernel(r), 0, 1))) for n, r in drawn if n >= index.least]
            raw = sum(n * s for n, s in scored) / sum(n for n, _ in scored) if scored else None
            out.append({**{k: rows[k].iloc[0] for k in own}, "metric_id": name, "raw": raw, "norm": 0.0 if raw is None else raw**index.power})
        return pd.DataFrame(out).astype({"raw": "float64"})

    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in own)
    kept = clustered(points).select(*own, "point_id", "x", "y", "label")
    return kept.groupBy(*(own or [F.lit(1).alias("_one")])).applyInPandas(run, ", ".join(filter(None, (kinds, "metric_id string, raw double, norm double"))))
