"""Synthetic point clouds from plans: a row per dataset in, its points out."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import profiles
from .search import spread

SHAPES: dict = {}


def register(name: str, shape=None):
    """Add a component (UDF-09): a function of a generator, a number of points and parameters."""

    def put(f):
        SHAPES[name] = f
        return f

    return put(shape) if shape else put


def turned(x: np.ndarray, angle: float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return x @ np.array(((c, s), (-s, c)))


def boxed(rng, n, cx, cy, width, height, orientation=0.0) -> np.ndarray:
    """Uniform points of a turned rectangle."""
    return turned(rng.uniform(-0.5, 0.5, (n, 2)) * (width, height), orientation) + (cx, cy)


def along(rng, n, vertices, thickness, closed=False) -> np.ndarray:
    """Points on a line through vertices, uniform in its length, with noise about it."""
    v = np.asarray(vertices, float)
    v = np.vstack((v, v[:1])) if closed else v
    return on_segments(rng, n, v[:-1], v[1:], thickness)


def on_segments(rng, n, first, last, thickness) -> np.ndarray:
    first, last = np.asarray(first, float).reshape(-1, 2), np.asarray(last, float).reshape(-1, 2)
    size = np.hypot(*(last - first).T)
    at = rng.choice(len(first), n, p=size / size.sum()) if size.sum() else np.zeros(n, int)
    u = rng.uniform(0, 1, (n, 1))
    return first[at] * (1 - u) + last[at] * u + rng.normal(0, thickness, (n, 2))


def scattered(rng, n, centers, sigmas, jitter=0.0, angles=None) -> np.ndarray:
    """Normal points around centres that are drawn with weights of about 1; sigmas may be (long, short) pairs turned by angles."""
    weight = np.clip(1 + rng.normal(0, jitter, len(centers)), 0.1, None)
    at = rng.choice(len(centers), n, p=weight / weight.sum())
    spread = np.asarray(sigmas, float)[at]
    off = rng.normal(size=(n, 2)) * (spread if spread.ndim == 2 else spread[:, None])
    if angles is not None:
        c, s = np.cos(angles[at]), np.sin(angles[at])
        off = np.column_stack((off[:, 0] * c - off[:, 1] * s, off[:, 0] * s + off[:, 1] * c))
    return np.asarray(centers)[at] + off


def where(rng, n, draw, keep, tries=64) -> np.ndarray:
    """n points of draw(count) for which keep(points) holds; of draw() alone if hardly any does."""
    out, missing = [], n
    for _ in range(tries):
        x = draw(max(64, 4 * missing))
        out.append(x[keep(x)][:missing])
        missing -= len(out[-1])
        if not missing:
            break
    return np.concatenate([*out, draw(missing)]) if missing else np.concatenate(out or [np.zeros((0, 2))])


def spans(rng, n, low, high, intervals=None) -> np.ndarray:
    """Uniform abscissas of a range, or of intervals in it by their length."""
    pairs = np.asarray(intervals if intervals else [(low, high)], float)
    size = np.maximum(pairs[:, 1] - pairs[:, 0], 1e-12)
    at = rng.choice(len(pairs), n, p=size / size.sum())
    return pairs[at, 0] + rng.uniform(0, 1, n) * size[at]


def around(rng, n, cx, cy, rx, ry, low=0.0, high=2 * np.pi, rotation=0.0) -> np.ndarray:
    a = rng.uniform(low, high, n)
    return turned(np.column_stack((rx * np.cos(a), ry * np.sin(a))), rotation) + (cx, cy)


@register("blob")
def blob(rng, n, scale=0.05, center=(0.5, 0.5), mu=None, sigma=None):
    return rng.normal(mu if mu is not None else center, sigma if sigma is not None else scale, (n, 2))


@register("ring")
def ring(rng, n, radius=0.3, thickness=0.02, center=(0.5, 0.5)):
    return around(rng, n, *center, *[radius + rng.normal(0, thickness, n)] * 2)


@register("circle")
def circle(rng, n, cx=0.0, cy=0.0, r=2.0, angle_low=0.0, angle_high=2 * np.pi, thickness=0.06):
    return around(rng, n, cx, cy, *[r + rng.normal(0, thickness, n)] * 2, angle_low, angle_high)


@register("ellipse")
def ellipse(rng, n, cx=0.0, cy=0.0, rx=1.4, ry=0.8, rotation=0.0, angle_low=0.0, angle_high=2 * np.pi, thickness=0.05, fill=False):
    share = np.sqrt(rng.uniform(0, 1, n)) if fill else 1 + rng.normal(0, thickness, n) / max(rx, ry)
    return around(rng, n, cx, cy, rx * share, ry * share, angle_low, angle_high, rotation)


@register("ring_annulus")
def ring_annulus(rng, n, cx=0.0, cy=0.0, inner_radius=0.6, outer_radius=1.0, angle_low=0.0, angle_high=2 * np.pi, ellipse_ratio=1.0, hole_offset=(0.0, 0.0)):
    """Uniform in area between two circles; hole_offset moves the inner one."""
    def draw(k):
        r = np.sqrt(rng.uniform(0, outer_radius**2, k))
        return around(rng, k, 0.0, 0.0, r, r, angle_low, angle_high)

    x = where(rng, n, draw, lambda p: np.hypot(*(p - np.asarray(hole_offset)).T) >= inner_radius)
    return x * (1, ellipse_ratio) + (cx, cy)


@register("arc")
def arc(rng, n, radius=0.3, thickness=0.02, start=0.0, span=np.pi, center=(0.5, 0.5)):
    return around(rng, n, *center, *[radius + rng.normal(0, thickness, n)] * 2, start, start + span)


@register("arch_chain")
def arch_chain(rng, n, x_low=0.0, x_high=6.0, n_arches=3, height=1.0, y_base=0.0, trend_slope=0.0, thickness=0.05, sharpness=2.0, mode="up_down", intervals=None):
    """Arches side by side, all up, all down, or in turns; sharpness is the exponent of their flanks."""
    edges = np.asarray(intervals, float) if intervals else None
    if edges is None:
        cut = np.linspace(x_low, x_high, n_arches + 1)
        edges = np.column_stack((cut[:-1], cut[1:]))
    at, u = rng.integers(0, len(edges), n), rng.uniform(0, 1, n)
    sign = {"up": np.ones(len(edges)), "down": -np.ones(len(edges)), "up_down": (-1.0) ** np.arange(len(edges))}[mode][at]
    x = edges[at, 0] + u * (edges[at, 1] - edges[at, 0])
    return np.column_stack((x, y_base + trend_slope * (x - x_low) + sign * height * (1 - np.abs(2 * u - 1) ** sharpness) + rng.normal(0, thickness, n)))


@register("line")
def line(rng, n, start=(0.1, 0.1), end=(0.9, 0.9), thickness=0.02):
    return along(rng, n, (start, end), thickness)


@register("band")
def band(rng, n, x_low=-1.0, x_high=1.0, slope=0.0, intercept=0.0, thickness=0.05, intervals=None, x_sampling="uniform", x_bins_per_interval=40, x_jitter_sigma=0.0, y_quantization_step=None, y_quantization_origin=0.0):
    x = spans(rng, n, x_low, x_high, intervals)
    if x_sampling == "grid":
        step = (x_high - x_low) / x_bins_per_interval
        x = x_low + np.round((x - x_low) / step) * step
    x = x + rng.normal(0, x_jitter_sigma, n)
    y = slope * x + intercept + rng.normal(0, thickness, n)
    if y_quantization_step:
        y = y_quantization_origin + np.round((y - y_quantization_origin) / y_quantization_step) * y_quantization_step
    return np.column_stack((x, y))


@register("parallel_bands")
def parallel_bands(rng, n, bands=None, n_bands=3, x_low=0.0, x_high=1.0, slope=0.2, intercept0=0.125, spacing=0.25, thickness=0.015, band_probs=None, intervals=None):
    count = bands or n_bands
    at, x = rng.choice(count, n, p=band_probs), spans(rng, n, x_low, x_high, intervals)
    return np.column_stack((x, slope * x + intercept0 + at * spacing + rng.normal(0, thickness, n)))


@register("parabola")
def parabola(rng, n, x_low=-3.0, x_high=3.0, a=0.7, x0=0.0, b=0.0, thickness=0.1, intervals=None):
    x = spans(rng, n, x_low, x_high, intervals)
    return np.column_stack((x, b + a * np.square(x - x0) + rng.normal(0, thickness, n)))


@register("meander_curve")
def meander_curve(rng, n, x_low=-3.0, x_high=3.0, y_center=0.0, amplitude=1.0, frequency=2.0, phase=0.0, amplitude_drift=0.0, frequency_drift=0.0, n_anchors=48, anchor_jitter=0.0, thickness=0.05):
    """A wave whose amplitude and frequency may drift, through jittered anchors."""
    u = np.linspace(0, 1, max(2, n_anchors))
    wave = amplitude * (1 + amplitude_drift * u) * np.sin(2 * np.pi * frequency * (1 + frequency_drift * u) * u + phase)
    return along(rng, n, np.column_stack((x_low + u * (x_high - x_low), y_center + wave)) + rng.normal(0, anchor_jitter, (len(u), 2)), thickness)


@register("spiral")
def spiral(rng, n, turns=2.0, radius=None, thickness=0.01, center=(0.5, 0.5), cx=None, cy=None, r_start=0.05, r_end=0.4, angle_offset=0.0):
    u = np.sqrt(rng.uniform(0.02, 1, n))
    r = r_start + ((radius or r_end) - r_start) * u + rng.normal(0, thickness, n)
    a = angle_offset + 2 * np.pi * turns * u
    return np.column_stack((r * np.cos(a), r * np.sin(a))) + (center[0] if cx is None else cx, center[1] if cy is None else cy)


@register("piecewise_polyline")
def piecewise_polyline(rng, n, vertices=((0.0, 0.0), (1.0, 1.0), (2.0, 0.0)), base_thickness=0.06, corner_rounding=0.0, closed=False):
    return along(rng, n, rounded_corners(np.asarray(vertices, float), corner_rounding, closed), base_thickness, closed)


def rounded_corners(v: np.ndarray, share: float, closed: bool) -> np.ndarray:
    """Each inner corner cut off at a share of its two sides."""
    if not share:
        return v
    before, after = np.roll(v, 1, 0), np.roll(v, -1, 0)
    share = min(share, 0.5)
    out = np.stack((v + share * (before - v), v + share * (after - v)), 1).reshape(-1, 2)
    return out if closed else np.vstack((v[:1], out[2:-2], v[-1:]))


@register("polygon")
def polygon(rng, n, n_sides=4, cx=0.0, cy=0.0, radius=1.0, rotation=0.0, boundary_thickness=0.05, corner_rounding=0.0, fill=False):
    a = rotation + 2 * np.pi * np.arange(max(3, n_sides)) / max(3, n_sides)
    v = rounded_corners(radius * np.column_stack((np.cos(a), np.sin(a))), corner_rounding, True)
    rim = along(rng, n, v, 0.0 if fill else boundary_thickness, True)
    return (rim * np.sqrt(rng.uniform(0, 1, (n, 1))) if fill else rim) + (cx, cy)


@register("rectangle_frame")
def rectangle_frame(rng, n, cx=0.0, cy=0.0, width=2.0, height=1.2, rotation=0.0, frame_thickness=0.05, fill=False):
    if fill:
        return boxed(rng, n, cx, cy, width, height, rotation)
    v = np.array(((-1, -1), (1, -1), (1, 1), (-1, 1))) * (width / 2, height / 2)
    return turned(along(rng, n, v, frame_thickness, True), rotation) + (cx, cy)


@register("junction")
def junction(rng, n, cx=0.0, cy=0.0, angles=(0.0, 2 * np.pi / 3, 4 * np.pi / 3), arm_lengths=1.2, thickness=0.06):
    a = np.asarray(angles, float)
    ends = np.broadcast_to(np.asarray(arm_lengths, float), a.shape)[:, None] * np.column_stack((np.cos(a), np.sin(a)))
    return on_segments(rng, n, np.zeros_like(ends), ends, thickness) + (cx, cy)


@register("branching_tree")
def branching_tree(rng, n, root=(0.0, 0.0), branching_factor=2, depth=3, angle_spread=1.2, segment_length=1.0, length_decay=0.72, pruning_probability=0.15, angle_jitter=0.08, segment_thickness=0.05):
    """A trunk whose ends fork level by level; the first branch of each fork is never pruned."""
    tips, first, last, size = [(np.asarray(root, float), np.pi / 2)], [], [], segment_length
    for level in range(depth):
        grown = []
        for at, heading in tips:
            fork = [0.0] if not level else np.linspace(-0.5, 0.5, branching_factor) * angle_spread if branching_factor > 1 else [0.0]
            for k, turn in enumerate(fork):
                if k and rng.uniform() < pruning_probability:
                    continue
                way = heading + turn + rng.normal(0, angle_jitter)
                end = at + size * np.array((np.cos(way), np.sin(way)))
                first.append(at), last.append(end), grown.append((end, way))
        tips, size = grown, size * length_decay
    return on_segments(rng, n, first, last, segment_thickness)


@register("fractal_dust")
def fractal_dust(rng, n, cx=0.0, cy=0.0, base_scale=1.8, depth=4, children_per_level=3, decay=0.5, jitter=0.08):
    """Offsets that shrink level by level, each of one of a few directions."""
    out = np.zeros((n, 2))
    for level in range(max(1, depth)):
        a = 2 * np.pi * rng.integers(0, children_per_level, n) / children_per_level + 0.7 * level
        out += base_scale * decay**level * 0.5 * np.column_stack((np.cos(a), np.sin(a)))
    return out + (cx, cy) + rng.normal(0, jitter * decay**depth, (n, 2))


@register("grid")
def grid(rng, n, rows=4, columns=4, thickness=0.01):
    i, j = rng.integers(0, rows, n), rng.integers(0, columns, n)
    return np.stack(((j + 0.5) / columns, (i + 0.5) / rows), 1) + rng.normal(0, thickness, (n, 2))


@register("grid_lattice")
def grid_lattice(rng, n, cx=0.0, cy=0.0, n_vertical=4, n_horizontal=4, spacing_x=1.0, spacing_y=1.0, line_thickness=0.05, jitter=0.0, missing_lines_prob=0.0, span_x=None, span_y=None):
    """Crossing lines; some may be missing, never all."""
    xs, ys = ((np.arange(k) - (k - 1) / 2) * step for k, step in ((n_vertical, spacing_x), (n_horizontal, spacing_y)))
    wide, high = span_x or max(1, n_vertical) * spacing_x, span_y or max(1, n_horizontal) * spacing_y
    lines = [((x, -high / 2), (x, high / 2)) for x in xs] + [((-wide / 2, y), (wide / 2, y)) for y in ys]
    kept = [s for s in lines if rng.uniform() >= missing_lines_prob] or lines[:1]
    first, last = np.array(kept, float).transpose(1, 0, 2)
    return on_segments(rng, n, first, last, line_thickness) + rng.normal(0, jitter, (n, 2)) + (cx, cy)


@register("ladder")
def ladder(rng, n, rungs=None, n_rungs=6, thickness=0.01, slope=0.0, base_intercept=None, rung_spacing=None, segment_x_len=1.0, x_center_low=0.5, x_center_high=0.5):
    count = rungs or n_rungs
    step = 1 / count if rung_spacing is None else rung_spacing
    middle, at = rng.uniform(x_center_low, x_center_high, count), rng.integers(0, count, n)
    x = middle[at] + rng.uniform(-0.5, 0.5, n) * segment_x_len
    return np.column_stack((x, (step / 2 if base_intercept is None else base_intercept) + at * step + slope * x + rng.normal(0, thickness, n)))


@register("blob_field")
def blob_field(rng, n, n_blobs=6, cx=0.0, cy=0.0, width=3.0, height=2.0, orientation=0.0, blob_sigma_min=0.08, blob_sigma_max=0.35, strength_jitter=0.15):
    return scattered(rng, n, boxed(rng, max(1, n_blobs), cx, cy, width, height, orientation), rng.uniform(blob_sigma_min, blob_sigma_max, max(1, n_blobs)), strength_jitter)


@register("micro_blob_texture")
def micro_blob_texture(rng, n, n_micro_blobs=24, cx=0.0, cy=0.0, width=2.6, height=2.0, clustered_centers=True, blob_sigma_min=0.03, blob_sigma_max=0.11, strength_jitter=0.2):
    count = max(1, n_micro_blobs)
    centers = rng.normal((cx, cy), (width / 4, height / 4), (count, 2)) if clustered_centers else boxed(rng, count, cx, cy, width, height)
    return scattered(rng, n, centers, rng.uniform(blob_sigma_min, blob_sigma_max, count), strength_jitter)


@register("anisotropic_grain_field")
def anisotropic_grain_field(rng, n, n_grains=20, cx=0.0, cy=0.0, width=3.0, height=2.2, grain_sigma_long=0.12, grain_sigma_short=0.035, orientation=0.0, orientation_jitter=0.25, strength_jitter=0.15):
    """Small elongated grains of about one direction."""
    count = max(1, n_grains)
    ways = orientation + rng.normal(0, orientation_jitter, count)
    return scattered(rng, n, boxed(rng, count, cx, cy, width, height), np.tile((grain_sigma_long, grain_sigma_short), (count, 1)), strength_jitter, ways)


@register("speckle_texture")
def speckle_texture(rng, n, cx=0.0, cy=0.0, width=3.0, height=2.0, speckle_rate=0.65, clustered_fraction=0.35, cluster_sigma=0.08):
    """Scattered points, thinned to the cells that a rate leaves, with some of them in clumps."""
    clumped = round(clustered_fraction * n)
    centers = boxed(rng, max(3, clumped // 40 + 2), cx, cy, 0.7 * width, 0.7 * height)
    on = rng.uniform(size=(32, 32)) < speckle_rate
    cell = lambda x: on[tuple(np.clip((x - (cx, cy)) / (width, height) * 32 + 16, 0, 31).astype(int).T)]
    return np.concatenate((where(rng, n - clumped, lambda k: boxed(rng, k, cx, cy, width, height), cell), scattered(rng, clumped, centers, np.full(len(centers), cluster_sigma))))


def _stripes(rng, n, cx, cy, width, height, orientation, count, spacing, sigma, phase=0.0, strength=0.0):
    """Parallel ridges across a turned rectangle."""
    weight = np.clip(1 + rng.normal(0, strength, count), 0.1, None)
    at = rng.choice(count, n, p=weight / weight.sum())
    across = (at - (count - 1) / 2) * spacing + phase + rng.normal(0, sigma, n)
    return turned(np.column_stack((rng.uniform(-0.5, 0.5, n) * width, np.clip(across, -height / 2, height / 2))), orientation) + (cx, cy)


@register("ridge_field")
def ridge_field(rng, n, cx=0.0, cy=0.0, width=3.0, height=2.0, n_ridges=5, orientation=0.0, spacing=0.5, ridge_sigma=0.06, jitter=0.02):
    return _stripes(rng, n, cx, cy, width, height, orientation, max(1, n_ridges), spacing, ridge_sigma) + rng.normal(0, jitter, (n, 2))


@register("oriented_texture_field")
def oriented_texture_field(rng, n, cx=0.0, cy=0.0, width=3.0, height=2.0, orientation=0.0, n_ridges=6, ridge_spacing=0.35, ridge_sigma=0.06, cross_sigma=0.45, phase_jitter=0.08, strength_jitter=0.15):
    """Ridges of different strength that fade to both ends."""
    x = turned(_stripes(rng, n, 0.0, 0.0, width, height, 0.0, max(1, n_ridges), ridge_spacing, ridge_sigma, rng.normal(0, phase_jitter), strength_jitter), 0.0)
    x[:, 0] = np.clip(rng.normal(0, cross_sigma * width, n), -width / 2, width / 2)
    return turned(x, orientation) + (cx, cy)


@register("striped_texture")
def striped_texture(rng, n, cx=0.0, cy=0.0, width=3.0, height=2.2, orientation=0.0, n_stripes=7, stripe_spacing=0.35, stripe_sigma=0.05, phase_offset=0.0, duty_cycle=0.55):
    """Filled stripes: the part of each period that the duty cycle leaves, with soft edges."""
    reach = n_stripes * stripe_spacing / 2
    keep = lambda x: (np.abs(x[:, 1]) <= reach) & (((x[:, 1] + reach) / stripe_spacing + phase_offset) % 1 < duty_cycle)
    x = where(rng, n, lambda k: boxed(rng, k, 0.0, 0.0, width, height), keep)
    return turned(x + np.column_stack((np.zeros(n), rng.normal(0, stripe_sigma * (1 - duty_cycle), n))), orientation) + (cx, cy)


@register("checker_texture")
def checker_texture(rng, n, cx=0.0, cy=0.0, width=3.0, height=3.0, cell_size_x=0.4, cell_size_y=0.4, orientation=0.0, on_probability=1.0, jitter=0.02):
    """Every second cell of a board, some of them empty."""
    seen = rng.uniform(size=(int(width / cell_size_x) + 2, int(height / cell_size_y) + 2)) < on_probability

    def keep(x):
        i, j = (np.floor((x[:, k] + half) / cell).astype(int) for k, half, cell in ((0, width / 2, cell_size_x), (1, height / 2, cell_size_y)))
        return ((i + j) % 2 == 0) & seen[i, j]

    x = where(rng, n, lambda k: boxed(rng, k, 0.0, 0.0, width, height), keep)
    return turned(x, orientation) + (cx, cy) + rng.normal(0, jitter, (n, 2))


@register("noise")
def noise(rng, n, mode="uniform", low=(0.0, 0.0), high=(1.0, 1.0), roi=None, strength=0.25, x_low=None, x_high=None, side="below", offset_min=1.0, offset_max=6.0, y_jitter_sigma=1.0, line_y=0.0):
    """Background points: uniform in bounds or a region, normal about the middle, or at one side of a line."""
    a, b = (np.asarray(v, float) for v in ((roi or {}).get("low", low), (roi or {}).get("high", high)))
    if mode == "gaussian":
        return np.clip(rng.normal((a + b) / 2, strength * (b - a), (n, 2)), a, b)
    if mode == "offset":
        x = spans(rng, n, a[0] if x_low is None else x_low, b[0] if x_high is None else x_high)
        away = rng.uniform(offset_min, offset_max, n) * {"below": -1, "above": 1}.get(side, 0) + (0 if side in ("below", "above") else rng.choice((-1, 1), n) * rng.uniform(offset_min, offset_max, n))
        return np.column_stack((x, line_y + away + rng.normal(0, y_jitter_sigma, n)))
    return rng.uniform(a, b, (n, 2))


@register("uniform")
def uniform(rng, n):
    return rng.uniform(0, 1, (n, 2))


def sample_prior(rng: np.random.Generator, spec):
    """A value of a prior {"dist": uniform, normal, loguniform or choice, ...}; other values stay, mappings are sampled field by field (GEN-12)."""
    if not isinstance(spec, dict):
        return spec
    kind = str(spec.get("dist", "")).lower()
    if not kind:
        return {k: sample_prior(rng, v) for k, v in spec.items()}
    if kind == "normal":
        return float(rng.normal(spec.get("mu", 0.0), spec.get("sigma", 1.0)))
    if kind == "choice":
        return spec["values"][int(rng.integers(len(spec["values"])))]
    if kind not in ("uniform", "loguniform"):
        raise ValueError(f"unknown prior: {kind!r}")
    low, high = float(spec["low"]), float(spec["high"])
    return float(rng.uniform(low, high)) if kind == "uniform" else float(low * (high / low) ** rng.uniform())


def topological(components: Sequence[dict]) -> list[dict]:
    """Components after their parents; a cycle is an error (GEN-07)."""
    by, out, state = {c["id"]: c for c in components}, [], {}

    def visit(i) -> None:
        if state.get(i) == 1:
            raise ValueError(f"components form a cycle at {i!r}")
        if i not in state:
            state[i] = 1
            for parent in by[i].get("parents", ()):
                visit(parent)
            state[i] = 2
            out.append(by[i])

    for c in components:
        visit(c["id"])
    return out


def generate(jobs: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """(keys, point_id, x, y, y_true) of jobs (keys, seed long, plan JSON) (GEN-06).

    plan: {"components": [{"id", "shape", "n", "params", "parents", "profiles"}], "perturb": {}}; params may be priors.
    A child is shifted to its first parent's centre. Bad shapes are errors.
    """
    names = list(keys)

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                plan, rng, centre = json.loads(row["plan"]), np.random.default_rng(int(row["seed"])), {}
                xs, ys = [], []
                for label, c in enumerate(topological(plan["components"])):
                    own = SHAPES[c["shape"]](rng, int(c["n"]), **sample_prior(rng, c.get("params", {})))
                    for name, setting in c.get("profiles", {}).items():
                        own = profiles.PROFILES[name](rng, own, setting)
                    if c.get("parents"):
                        own = own - own.mean(0) + centre[c["parents"][0]] + np.array(c.get("offset", (0.0, 0.0)))
                    centre[c["id"]] = own.mean(0)
                    xs.append(own), ys.append(np.full(len(own), label))
                x, y = profiles.perturb(rng, np.concatenate(xs), np.concatenate(ys), plan.get("perturb", {}))
                yield pd.DataFrame({**{k: row[k] for k in names}, "point_id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "y_true": y.astype("int32")})

    kinds = ", ".join(f"{c} {jobs.schema[c].dataType.simpleString()}" for c in names)
    return spread(jobs.select(*names, "seed", "plan"), *names).mapInPandas(run, f"{kinds}, point_id long, x double, y double, y_true int")
