"""Outlines and fitted shapes in NumPy: borders of masks, polygons, hulls, circles and ellipses.

Points are rows (row, column) of a mask, or any plane coordinates; areas and
lengths are those of the polygon through pixel centres.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-12
#: Steps to the eight neighbours, clockwise from the right.
RING = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def hull(z: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by a monotone chain (FN-22)."""
    pts = np.unique(z, axis=0)
    if len(pts) < 3:
        return pts

    def half(points):
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def polygon(p: np.ndarray) -> tuple[float, float]:
    """(area, perimeter)."""
    q = np.roll(p, -1, 0)
    return abs(float((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum())) / 2, float(np.sqrt(((p - q) ** 2).sum(1)).sum())


def trace(mask: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """Outer border of the 8-connected part whose first pixel in reading order is start, pixel by pixel.

    At each pixel the neighbours are tried clockwise from the one after where
    the walk came from; it ends when its first step would be made again. Pixels
    of thin parts are passed on both sides and come twice.
    """
    m = np.pad(mask, 1)
    at, came, out, first = (start[0] + 1, start[1] + 1), 4, [], None
    while True:
        for turn in range(1, 9):
            d = (came + turn) % 8
            if m[at[0] + RING[d][0], at[1] + RING[d][1]]:
                break
        else:
            return np.array([start], float)
        if first == (at, d):
            return np.array(out, float) - 1
        first = first or (at, d)
        out.append(at)
        at, came = (at[0] + RING[d][0], at[1] + RING[d][1]), (d + 4) % 8


def largest_contour(labels: np.ndarray, n: int) -> np.ndarray | None:
    """Border with the largest area of the labelled parts (1 to n); None where no area is above 1."""
    best, area = None, 1.0
    flat = labels.ravel()
    present, first = np.unique(flat, return_index=True)
    size = np.bincount(flat, minlength=n + 1)
    for label, at in zip(present.tolist(), first.tolist(), strict=True):
        if label and size[label] > 3:  # three pixels enclose half a pixel at most
            found = trace(labels == label, divmod(at, labels.shape[1]))
            own = polygon(found)[0]
            if own > area:
                best, area = found, own
    return best


def _off_line(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points to the line through a and b, to a where both are one."""
    side = b - a
    length = np.hypot(*side)
    return np.hypot(*(p - a).T) if length < EPS else np.abs(side[0] * (p - a)[:, 1] - side[1] * (p - a)[:, 0]) / length


def simplify_closed(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Corners of a closed outline, every point of it within tolerance of its side (Douglas and Peucker).

    The outline is cut at two points far from each other; corners that lie
    almost on the line between their neighbours are dropped at the end.
    """
    n, a = len(p), 0
    if n < 3:
        return p
    for _ in range(3):
        b, a = a, int(((p - p[a]) ** 2).sum(1).argmax())
    if a == b:
        return p[:1]
    first, last = sorted((a, b))
    ring, kept = np.concatenate([p[first:], p[: first + 1]]), {0, last - first}
    todo = [(0, last - first), (last - first, n)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d = _off_line(ring[i + 1 : j], ring[i], ring[j])
        k = int(d.argmax())
        if d[k] > tolerance:
            kept.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    out = ring[sorted(kept)]
    at = 0
    while len(out) > 3 and at < len(out):
        before, after = out[at - 1], out[(at + 1) % len(out)]
        between = (out[at] - before) @ (after - out[at]) >= 0
        if between and 2 * _off_line(out[at : at + 1], before, after)[0] ** 2 <= tolerance**2:
            out = np.delete(out, at, 0)
        else:
            at += 1
    return out


def fill(shape: tuple[int, int], p: np.ndarray) -> np.ndarray:
    """Pixels inside a closed polygon or on its sides."""
    crossings = np.zeros((shape[0], shape[1] + 1), bool)
    out = np.zeros(shape, bool)
    for a, b in zip(p, np.roll(p, -1, 0), strict=True):
        low, high = (a, b) if a[0] <= b[0] else (b, a)
        rows = np.arange(np.ceil(low[0]), np.ceil(high[0])).astype(int)
        if len(rows):
            x = low[1] + (rows - low[0]) * (high[1] - low[1]) / (high[0] - low[0])
            crossings[rows, np.clip(np.ceil(x), 0, shape[1]).astype(int)] ^= True
        steps = int(np.abs(b - a).max()) + 1
        line = np.rint(a + np.linspace(0, 1, steps + 1)[:, None] * (b - a)).astype(int)
        out[line[:, 0].clip(0, shape[0] - 1), line[:, 1].clip(0, shape[1] - 1)] = True
    return out | np.logical_xor.accumulate(crossings, axis=1)[:, :-1]


def least_rectangle(p: np.ndarray) -> tuple[float, float]:
    """Sides of the rectangle of least area around the points: one of its sides lies on a side of their hull."""
    h = hull(p)
    if len(h) < 3:
        return float(np.hypot(*np.ptp(h, axis=0))) if len(h) else 0.0, 0.0
    side = np.roll(h, -1, 0) - h
    side = side / np.hypot(*side.T)[:, None]
    along = np.ptp(h @ side.T, axis=0)
    across = np.ptp(h @ np.column_stack((-side[:, 1], side[:, 0])).T, axis=0)
    best = int((along * across).argmin())
    return float(along[best]), float(across[best])


def fit_ellipse(p: np.ndarray) -> tuple[np.ndarray, float, float, float] | None:
    """(centre, half axes, larger first, angle of the larger) of the least-squares ellipse; None without one.

    The direct method: the conic of least algebraic distance among ellipses.
    """
    if len(p) < 5:
        return None
    middle = p.mean(0)
    scale = np.abs(p - middle).max()
    if scale < EPS:
        return None
    x, y = ((p - middle) / scale).T
    square, line = np.column_stack((x * x, x * y, y * y)), np.column_stack((x, y, np.ones_like(x)))
    s1, s2, s3 = square.T @ square, square.T @ line, line.T @ line
    try:
        t = -np.linalg.solve(s3, s2.T)
        values, vectors = np.linalg.eig(np.array([[0, 0, 0.5], [0, -1, 0], [0.5, 0, 0]]) @ (s1 + s2 @ t))
    except np.linalg.LinAlgError:
        return None
    vectors = np.real(vectors)
    found = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 0)
    if not len(found):
        return None
    a, b, c = vectors[:, found[0]]
    d, e, f = t @ vectors[:, found[0]]
    matrix = np.array([[a, b / 2], [b / 2, c]])
    centre = np.linalg.solve(-2 * matrix, np.array([d, e]))
    level = -(f + (d * centre[0] + e * centre[1]) / 2)
    values, turned = np.linalg.eigh(matrix * np.sign(level) if level else matrix)
    if not level or values[0] <= 0:
        return None
    half = np.sqrt(abs(level) / values) * scale  # the least eigenvalue has the larger axis
    return middle + centre * scale, float(half[0]), float(half[1]), float(np.arctan2(turned[1, 0], turned[0, 0]))


def _circle(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Circle through three points, or over two; the widest pair's where three lie on a line."""
    if len(p) == 3:
        a, b = p[1] - p[0], p[2] - p[0]
        cross = 2 * (a[0] * b[1] - a[1] * b[0])
        if abs(cross) > EPS:
            c = p[0] + np.array([b[1] * (a @ a) - a[1] * (b @ b), a[0] * (b @ b) - b[0] * (a @ a)]) / cross
            return c, float(np.hypot(*(p[0] - c)))
        p = max(((p[0], p[1]), (p[0], p[2]), (p[1], p[2])), key=lambda q: np.hypot(*(q[0] - q[1])))
    c = (p[0] + p[-1]) / 2
    return c, float(np.hypot(*(p[0] - c)))


def enclosing_circle(z: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of the smallest circle around the points, exact: each point outside is on the next circle's rim."""
    p = hull(z)
    outside = lambda part, c: np.flatnonzero(np.hypot(*(part - c[0]).T) > c[1] * (1 + 1e-10) + EPS)
    circle = (p[0], 0.0)
    i = 0
    while len(found := outside(p[i:], circle)):
        i += int(found[0])
        circle, j = (p[i], 0.0), 0
        while len(found := outside(p[j:i], circle)):
            j += int(found[0])
            circle, k = _circle(p[[i, j]]), 0
            while len(found := outside(p[k:j], circle)):
                k += int(found[0])
                circle = _circle(p[[i, j, k]])
    return circle
