"""Traced outlines, fitted shapes, and the raster indices on them: values by hand."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clusterloom.operators import contours, patterns, rasters
from clusterloom.operators.rasters import SIZE, RASTERS, Raster, grid_score, ridge_response

Y, X = np.indices((SIZE, SIZE))


def drawn(mask) -> Raster:
    return Raster(rasters.blur(mask.astype(float), 1.0), mask, mask.astype(float))


def score(name, mask) -> float:
    return RASTERS[name].kernel(drawn(mask))


SQUARE = (Y >= 60) & (Y <= 180) & (X >= 70) & (X <= 190)
DISC = (Y - 128) ** 2 + (X - 128) ** 2 <= 80**2
RING = DISC & ((Y - 128) ** 2 + (X - 128) ** 2 >= 60**2)
ELL = ((Y >= 40) & (Y <= 200) & (X >= 40) & (X <= 80)) | ((Y >= 160) & (Y <= 200) & (X >= 40) & (X <= 200))
t = np.arange(10) * np.pi / 5
STAR = contours.fill((SIZE, SIZE), 128 + np.where(np.arange(10) % 2, 40, 100)[:, None] * np.column_stack((np.cos(t), np.sin(t))))


def outline(mask):
    return contours.largest_contour(*rasters.components(mask))


def test_borders_by_hand():
    p = outline(SQUARE)
    assert len(p) == 480 and contours.polygon(p) == (120.0**2, 480.0)
    assert {tuple(q) for q in p} == {tuple(q) for q in np.argwhere(rasters.edges(SQUARE)).astype(float)}
    bar = np.zeros((9, 9), bool)
    bar[4, 2:7] = True  # a line is passed on both sides
    assert contours.trace(bar, (4, 2)).tolist() == [[4, x] for x in (2, 3, 4, 5, 6, 5, 4, 3)]
    assert contours.largest_contour(*rasters.components(bar)) is None
    dot = np.zeros((3, 3), bool)
    dot[1, 1] = True
    assert contours.trace(dot, (1, 1)).tolist() == [[1, 1]]
    assert contours.polygon(outline(RING)) == contours.polygon(outline(DISC))  # holes do not count
    both = SQUARE.copy()
    both[5:20, 5:20] = True
    assert contours.polygon(outline(both))[0] == 120.0**2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_borders_enclose_their_part(seed):
    """Every pixel of the part is on or inside the border, and border pixels are pixels of the part."""
    rng = np.random.default_rng(seed)
    mask = rasters.dilate(rng.random((24, 24)) < 0.06, 1)
    labels, n = rasters.components(mask)
    for label in range(1, n + 1):
        own = labels == label
        p = contours.trace(own, tuple(np.argwhere(own)[0]))
        assert own[tuple(p.astype(int).T)].all()
        if len(p) > 2:
            filled = contours.fill(own.shape, p)
            assert (own & ~filled).sum() == 0


def test_simplified_outlines():
    assert len(contours.simplify_closed(outline(SQUARE), 9.6)) == 4
    assert len(contours.simplify_closed(outline(ELL), 5.0)) == 6
    assert len(contours.simplify_closed(outline(STAR), 8.0)) == 10
    p = outline(STAR)
    corners = contours.simplify_closed(p, 8.0)
    side = [contours._off_line(p, a, b) for a, b in zip(corners, np.roll(corners, -1, 0), strict=True)]
    assert np.min(side, axis=0).max() <= 8.0


def test_fitted_ellipse_and_rectangle():
    a = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    turn = 0.6
    p = np.column_stack((30 * np.cos(a), 12 * np.sin(a))) @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]]) + [100, 50]
    c, major, minor, angle = contours.fit_ellipse(p)
    assert np.allclose(c, [100, 50]) and np.allclose([major, minor], [30, 12]) and np.isclose(angle % np.pi, turn)
    assert contours.fit_ellipse(p[:4]) is None and contours.fit_ellipse(np.ones((9, 2))) is None
    box = np.array([[0, 0], [6, 8], [2, 11], [-4, 3], [1, 4]], float)  # sides 10 and 5, turned
    assert sorted(np.round(contours.least_rectangle(box), 9)) == [5.0, 10.0]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=14))
def test_enclosing_circle_is_the_least(points):
    z = np.array(points, float)
    c, r = contours.enclosing_circle(z)
    d = np.hypot(*(z - c).T)
    assert d.max() <= r + 1e-6
    # No other circle over two or three of the points holds all of them in less.
    best = 0.0 if len(np.unique(z, axis=0)) == 1 else np.inf
    for i in range(len(z)):
        for j in range(i):
            for k in range(-1, j):
                o, s = contours._circle(z[[i, j]] if k < 0 else z[[i, j, k]])
                if np.hypot(*(z - o).T).max() <= s + 1e-7:
                    best = min(best, s)
    assert r == pytest.approx(best, abs=1e-6)


def test_circularity():
    assert score("circularity_compactness", SQUARE) == pytest.approx(np.pi / 4, abs=1e-6)  # 4 pi a^2 / (4 a)^2
    area, length = contours.polygon(outline(DISC))
    assert score("circularity_compactness", DISC) == pytest.approx(4 * np.pi * area / length**2) and score("circularity_compactness", DISC) > 0.85
    assert score("circularity_compactness", RING) == score("circularity_compactness", DISC)
    assert score("circularity_compactness", STAR) < 0.5 < score("circularity_compactness", SQUARE)


def test_rectangularity():
    assert score("rectangularity", SQUARE) == pytest.approx(1.0, abs=1e-6)
    assert score("rectangularity", ELL) == pytest.approx((160 * 160 - 120 * 120) / 160**2, abs=0.01)
    assert score("rectangularity", DISC) == pytest.approx(np.pi / 4, abs=0.01)


def test_polygonality():
    assert score("polygonality", SQUARE) == pytest.approx(8 / 9, abs=1e-6)  # whole overlap, four corners
    assert score("polygonality", ELL) == pytest.approx(6 / 9, abs=0.02)
    assert score("polygonality", STAR) == pytest.approx(2 / 9, abs=0.03)  # ten corners
    assert score("polygonality", np.zeros_like(SQUARE)) == 0


def test_ellipse_support():
    wide = ((Y - 128) / 50) ** 2 + ((X - 128) / 90) ** 2 <= 1
    assert score("ellipse_fit_score", wide) == 1.0 and score("ellipse_fit_score", DISC) == 1.0
    assert score("ellipse_fit_score", STAR) < 0.4 and 0.05 < score("ellipse_fit_score", SQUARE) < 0.6


def test_ridges():
    line = np.zeros((SIZE, SIZE))
    line[:, 128] = 255.0
    response = ridge_response(line)
    assert response[:, 128].min() > 0 and (response.argmax(1) == 128).all() and response[:, :100].max() == 0
    # One scale by hand: xx of (k0, k1, k1) columns is 4 (k1 - 2 k0 + k1), smoothed over rows by 4.
    g = rasters.blur(line / 255, 1.0)[128]
    xx = 4 * (g[127] - 2 * g[128] + g[129])
    assert ridge_response(line, (1.0,))[128, 128] == pytest.approx(1 - np.exp(-(xx**2) / 450), rel=1e-6)
    assert score("ridge_strength", (np.abs(X - Y) < 3)) > score("ridge_strength", DISC)


def test_grids_of_peaks_by_hand():
    pair = lambda dy, dx, v: [[dy, dx, v], [-dy, -dx, v]]
    strengths = np.mean([0.8, 0.8, 0.6, 0.6])
    # The two strongest pairs are both ends of one axis: 0 degrees apart.
    right = np.exp(-(90**2) / (2 * 25**2))
    assert grid_score(np.array(pair(0, 30, 0.8) + pair(30, 0, 0.6))) == pytest.approx(strengths * (0.6 + 0.4 * right))
    assert grid_score(np.array([[0, 30, 0.5], [3, 33, 0.3]])) == pytest.approx(0.6 * 0.4)
    assert grid_score(np.array([[0, 30, 0.5]])) == 0
    dots = (Y % 24 < 3) & (X % 24 < 3)
    assert score("gridness_fft_acf", dots) > score("gridness_fft_acf", DISC)


def test_arcs_and_circles():
    loose = RING & (np.random.default_rng(2).random(RING.shape) < 0.08)  # points around a circle of 70 pixels
    assert score("hough_arc_circle_strength", loose) > 0.2 > score("hough_arc_circle_strength", SQUARE)
    step = np.where(X < 100, 0.0, 200.0)
    assert set(np.argwhere(rasters.canny(step, 50, 150))[:, 1]) <= {99, 100} and rasters.canny(step, 50, 150).sum() == SIZE
    assert rasters.canny(step / 100, 50, 150).sum() == 0
    a = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    assert patterns.arc_circle_fit(np.column_stack((np.cos(a), np.sin(a)))) == pytest.approx(1.0, abs=1e-6)
    oval = np.column_stack((2 * np.cos(a), np.sin(a)))
    r = np.hypot(*oval.T)
    assert patterns.arc_circle_fit(oval) == pytest.approx(np.exp(-r.std() / r.mean()) * (0.6 + 0.4 * 0.5), abs=1e-6)


def test_few_edges_have_no_dimension():
    assert score("fractal_dimension", (Y < 4) & (X < 4)) == 0 < score("fractal_dimension", DISC)
