"""Profiles of a generated component and perturbations of a generated dataset (GEN-09, GEN-10).

A profile changes the points of one component; its setting is a name, or a
mapping with a 'profile' name and strengths. Positions along a component are
the angle about its centre for round ones, else the place along its main axis.
"""

from __future__ import annotations

import numpy as np

PROFILES: dict = {}


def profile(name: str):
    def put(f):
        def run(rng, x, setting):
            own = {"profile": setting} if isinstance(setting, str) else dict(setting)
            kind = str(own.pop("profile", "none")).lower()
            if kind in ("", "none", "native") or not len(x):
                return x
            return f(rng, x, kind, **own)

        PROFILES[name] = run
        return run

    return put


def _unknown(name: str, kind: str):
    raise ValueError(f"unknown {name}: {kind!r}")


def frame(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, main axis, side axis)."""
    middle = x.mean(0)
    axes = np.linalg.eigh(np.cov((x - middle).T) + 1e-12 * np.eye(2))[1] if len(x) > 2 else np.eye(2)
    return middle, axes[:, 1], axes[:, 0]


def place(x: np.ndarray) -> np.ndarray:
    """Position of each point along the component, 0 to 1."""
    middle, main, _ = frame(x)
    r = np.hypot(*(x - middle).T)
    if r.mean() > 0 and r.std() < 0.25 * r.mean():  # round: hollow about its centre
        return (np.arctan2(*(x - middle).T[::-1]) + np.pi) / (2 * np.pi)
    t = (x - middle) @ main
    return (t - t.min()) / max(float(np.ptp(t)), 1e-12)


def across(x: np.ndarray) -> np.ndarray:
    """Unit vector of each point across the component: away from the centre where it is round, else the side axis."""
    middle, _, side = frame(x)
    off = x - middle
    r = np.hypot(*off.T)
    return off / np.maximum(r, 1e-12)[:, None] if r.mean() > 0 and r.std() < 0.25 * r.mean() else np.tile(side, (len(x), 1))


def size(x: np.ndarray) -> float:
    return float(np.ptp(x, axis=0).max()) if len(x) else 0.0


def spread_out(x: np.ndarray, factor: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
    """Distances from the smoothed course of the component times a factor."""
    t, way = place(x), across(x)
    off = ((x - x.mean(0)) * way).sum(1)
    bins = np.minimum((t * 24).astype(int), 23)
    total, n = np.bincount(bins, off, 24), np.bincount(bins, minlength=24)
    course = (total / np.maximum(n, 1))[bins] if centre is None else centre
    return x + ((factor - 1) * (off - course))[:, None] * way


@profile("sampling")
def sampling(rng, x, kind, strength=0.8):
    """Denser at the ends, the centre, one side, or in bursts: points are drawn again by a weight of their position."""
    t = place(x)
    weight = {"uniform": np.ones_like(t), "center_dense": np.exp(-8 * strength * (t - 0.5) ** 2), "edge_dense": 1 - strength + strength * np.abs(2 * t - 1), "left_dense": 1 - strength * t, "right_dense": 1 - strength * (1 - t), "bursty": 1 - strength * (np.sin(10 * np.pi * t) < 0)}.get(kind)
    if weight is None:
        _unknown("sampling profile", kind)
    weight = np.clip(weight, 1e-6, None)
    return x[np.sort(rng.choice(len(x), len(x), p=weight / weight.sum()))]


@profile("thickness")
def thickness(rng, x, kind, low=0.5, high=2.0):
    """Thickness that changes along the component."""
    t = place(x)
    factor = {"constant": np.ones_like(t), "linear_taper": low + (high - low) * t, "center_bulge": low + (high - low) * (1 - np.abs(2 * t - 1)), "end_bulge": low + (high - low) * np.abs(2 * t - 1), "periodic": low + (high - low) * (0.5 + 0.5 * np.sin(8 * np.pi * t))}.get(kind)
    return spread_out(x, factor) if factor is not None else _unknown("thickness profile", kind)


@profile("fragmentation")
def fragmentation(rng, x, kind, n_gaps=4, gap_share=0.3):
    """Gaps: regular, random, dropped windows, or every second piece."""
    t = place(x)
    phase = t * n_gaps
    if kind == "regular_gaps":
        keep = phase % 1 >= gap_share
    elif kind == "alternating_presence":
        keep = phase.astype(int) % 2 == 0
    elif kind == "random_gaps":
        starts = rng.uniform(0, 1 - gap_share / n_gaps, n_gaps)
        keep = ~((t[:, None] >= starts) & (t[:, None] < starts + gap_share / n_gaps)).any(1)
    elif kind == "dropout_windows":
        gone = rng.uniform(size=max(1, 3 * n_gaps)) < gap_share
        keep = ~gone[np.minimum((t * len(gone)).astype(int), len(gone) - 1)]
    else:
        _unknown("fragmentation profile", kind)
    return x[keep] if keep.any() else x[:1]


@profile("roughness")
def roughness(rng, x, kind, amplitude=0.03, waves=12):
    """An edge that wobbles, is jagged, or is noisy; the amplitude is a share of the component's size."""
    t = place(x)
    if kind == "periodic_wobble":
        off = np.sin(2 * np.pi * waves * t)
    elif kind == "jagged":
        off = 2 * np.abs((waves * t) % 1 * 2 - 1) - 1
    elif kind == "gaussian_edge":
        off = rng.normal(size=len(x))
    else:
        _unknown("roughness profile", kind)
    return x + (amplitude * size(x) * off)[:, None] * across(x)


@profile("fill")
def fill(rng, x, kind, share=0.3):
    """Only the rim, a filled area, or a shell of some depth."""
    middle = x.mean(0)
    off = x - middle
    r = np.hypot(*off.T)
    angle = np.minimum(((np.arctan2(*off.T[::-1]) + np.pi) / (2 * np.pi) * 36).astype(int), 35)
    reach = np.zeros(36)
    np.maximum.at(reach, angle, r)
    edge = np.maximum(reach[angle], 1e-12)
    if kind == "filled":
        return middle + off / np.maximum(r, 1e-12)[:, None] * (edge * np.sqrt(rng.uniform(0, 1, len(x))))[:, None]
    least = {"boundary_only": 0.97, "shell": 1 - share}.get(kind)
    if least is None:
        _unknown("fill mode", kind)
    to = edge * rng.uniform(least, 1, len(x))
    return middle + off / np.maximum(r, 1e-12)[:, None] * to[:, None]


@profile("symmetry")
def symmetry(rng, x, kind):
    """Mirrored or turned copies of the points about the centre; half, a third or a quarter of them each."""
    middle = x.mean(0)
    maps = {"axial_x": [(1, -1)], "axial_y": [(-1, 1)], "central": [(-1, -1)], "rotational_2": [(-1, -1)]}
    off = x - middle
    if kind in maps:
        parts = [off, *(off * m for m in maps[kind])]
    elif kind == "rotational_4":
        parts = [off, off[:, ::-1] * (-1, 1), -off, off[:, ::-1] * (1, -1)]
    elif kind == "weak":
        parts = [off, off * (-1, 1) + rng.normal(0, 0.05 * size(x), off.shape)]
    else:
        _unknown("symmetry profile", kind)
    at = rng.integers(0, len(parts), len(x))
    return middle + np.stack(parts)[at, np.arange(len(x))]


@profile("periodicity")
def periodicity(rng, x, kind, periods=6, duty=0.5):
    """Presence in periods along the component: even, jittered, in one part, or with some missing."""
    t = place(x)
    step = np.minimum((t * periods).astype(int), periods - 1)
    phase = t * periods - step
    if kind == "uniform_periodic":
        keep = phase < duty
    elif kind == "jittered_periodic":
        keep = phase < np.clip(duty + rng.normal(0, 0.15, periods), 0.1, 0.95)[step]
    elif kind == "locally_periodic":
        keep = (phase < duty) | (np.abs(t - 0.5) > 0.25)
    elif kind == "broken_periodic":
        seen = rng.uniform(size=periods) > 0.3
        keep = (phase < duty) & seen[step]
    else:
        _unknown("periodicity profile", kind)
    return x[keep] if keep.any() else x[:1]


@profile("junction")
def junction(rng, x, kind):
    """Points pulled to the middle where arms meet, more or less, or to one arm."""
    middle, off = x.mean(0), x - x.mean(0)
    if kind in ("weak", "center_dense", "strong"):
        share = {"weak": 0.15, "center_dense": 0.25, "strong": 0.4}[kind]
        at = rng.uniform(size=len(x)) < share
        return np.where(at[:, None], middle + off * rng.uniform(0, 0.4, (len(x), 1)), x)
    if kind != "branch_biased":
        _unknown("junction profile", kind)
    way = rng.uniform(0, 2 * np.pi)
    weight = 1 + 2 * (off @ np.array((np.cos(way), np.sin(way))) > 0)
    return x[np.sort(rng.choice(len(x), len(x), p=weight / weight.sum()))]


@profile("curvature")
def curvature(rng, x, kind, strength=0.3):
    """The course across the main axis stretched, flattened, bent in waves, or kinked."""
    middle, main, side = frame(x)
    u, v = (x - middle) @ main, (x - middle) @ side
    half = max(float(np.abs(u).max()), 1e-12)
    bent = {"amplify": v * (1 + strength), "flatten": v * (1 - strength), "sinusoidal_warp": v + strength * half * 0.5 * np.sin(2 * np.pi * u / half), "piecewise_kink": v + strength * np.maximum(u, 0)}.get(kind)
    return middle + u[:, None] * main + bent[:, None] * side if bent is not None else _unknown("curvature profile", kind)


@profile("occlusion")
def occlusion(rng, x, kind, share=0.25):
    """A part of the component hidden: the centre, one side, or a patch."""
    t = place(x)
    if kind == "random_patch":
        centre = x[rng.integers(len(x))]
        keep = np.hypot(*(x - centre).T) > share * size(x) / 2
    else:
        keep = {"center_occluded": np.abs(t - 0.5) > share / 2, "left_occluded": t > share, "right_occluded": t < 1 - share}.get(kind)
        if keep is None:
            _unknown("occlusion profile", kind)
    return x[keep] if keep.any() else x[:1]


@profile("texture")
def texture(rng, x, kind, amplitude=0.01):
    """Fine structure of the points: stripes, grains, speckles, one direction, or several scales."""
    t, step = place(x), amplitude * size(x)
    if kind == "granular":
        return x + rng.normal(0, 0.8 * step, x.shape)
    if kind == "speckled":
        return x + rng.normal(0, 2 * step, x.shape) * (rng.uniform(size=(len(x), 1)) < 1 / 6)
    if kind == "oriented":
        way = rng.uniform(0, np.pi)
        u = x @ np.array((np.cos(way), np.sin(way)))
        wave = np.sin(2 * np.pi * u / max(float(u.std()), 1e-12))
    else:
        wave = {"striped": np.sin(16 * np.pi * t), "multiscale": np.sin(8 * np.pi * t) + 0.5 * np.sin(22 * np.pi * t)}.get(kind)
        if wave is None:
            _unknown("texture profile", kind)
    return x + (step * wave)[:, None] * across(x)


@profile("topology")
def topology(rng, x, kind):
    """The component cut in two, or with an added loop, bridge or twigs."""
    t, middle, main, _ = place(x), *frame(x)
    if kind in ("disconnected", "fragmented"):
        keep = np.abs(t - 0.5) > {"disconnected": 0.12, "fragmented": 0.2}[kind]
        return x[keep] if keep.any() else x[:1]
    n, reach = max(12, len(x) // 8), size(x)
    if kind == "looped":
        a = np.linspace(0, 2 * np.pi, n, endpoint=False)
        more = middle + 0.06 * reach * np.column_stack((np.cos(a), np.sin(a)))
    elif kind == "bridged":
        u = (x - middle) @ main
        more = middle + np.linspace(*np.quantile(u, (0.15, 0.85)), n)[:, None] * main + rng.normal(0, 0.01 * reach, (n, 2))
    elif kind == "tree_like":
        a, r = np.array((-0.8, -0.2, 0.4))[rng.integers(0, 3, n)], rng.uniform(0, 0.18 * reach, n)
        more = middle + np.column_stack((r * np.cos(a), r * np.sin(a)))
    else:
        _unknown("topology profile", kind)
    return np.vstack((x, more))


def _keep(x, y, keep):
    return x[keep], y[keep]


def size_imbalance(rng, x, y, strength):
    """Each cluster keeps a share of its points between 1 - strength (0.12 at least) and all."""
    labels, at = np.unique(y, return_inverse=True)
    rate = rng.uniform(max(0.12, 1 - strength), 1, len(labels))
    return _keep(x, y, rng.uniform(size=len(x)) < rate[at]) if len(labels) > 1 else (x, y)


def density_imbalance(rng, x, y, strength):
    """Clusters thinned towards their rim or their centre."""
    keep = np.ones(len(x), bool)
    for label in np.unique(y):
        at = np.flatnonzero(y == label)
        d = np.hypot(*(x[at] - x[at].mean(0)).T)
        if len(at) >= 12 and np.ptp(d) > 0:
            d = (d - d.min()) / np.ptp(d)
            chance = 1 - strength * (d if rng.integers(2) else 1 - d)
            keep[at] = rng.uniform(size=len(at)) < np.clip(chance, 0.15, 1)
    return _keep(x, y, keep)


def holes(rng, x, y, spec):
    """Discs without points: listed as (x, y, radius), or a number about random points."""
    if isinstance(spec, dict):
        r = spec.get("radius_scale", 0.18) * size(x) / 2
        spec = [(*x[i], r) for i in rng.integers(0, len(x), int(spec.get("n_holes", 1)))]
    for cx, cy, r in spec:
        x, y = _keep(x, y, np.hypot(*(x - (cx, cy)).T) > r)
    return x, y


def bridges(rng, x, y, spec, noise=-1):
    """Noise points on lines between the centres of random pairs of clusters."""
    own = {"n_bridges": int(spec)} if not isinstance(spec, dict) else spec
    labels, n = np.unique(y[y != noise]), int(own.get("points_per_bridge", 80))
    for _ in range(int(own.get("n_bridges", 0)) if len(labels) > 1 else 0):
        a, b = (x[y == c].mean(0) for c in rng.choice(labels, 2, replace=False))
        u = np.linspace(0, 1, max(2, n))[:, None]
        x = np.vstack((x, a + u * (b - a) + rng.normal(0, own.get("sigma", 0.03), (len(u), 2))))
        y = np.append(y, np.full(len(u), noise))
    return x, y


def contamination(rng, x, y, spec, noise=-1):
    """Noise points: uniform in the box of the points or, with a sigma, near random points."""
    own = {"rate": spec} if not isinstance(spec, dict) else spec
    n = int(own.get("rate", 0) * len(x))
    more = x[rng.integers(0, len(x), n)] + rng.normal(0, own["sigma"], (n, 2)) if own.get("sigma") else rng.uniform(x.min(0), x.max(0), (n, 2))
    return np.vstack((x, more)), np.append(y, np.full(n, noise))


def duplicates(rng, x, y, spec):
    own = {"rate": spec} if not isinstance(spec, dict) else spec
    at = rng.integers(0, len(x), int(own.get("rate", 0) * len(x)))
    return np.vstack((x, x[at] + rng.normal(0, own.get("jitter", 0.0), (len(at), 2)))), np.append(y, y[at])


def difficulty(rng, x, y, spec):
    """Jitter of all points, by feature or as a whole, and flipped labels."""
    sigma = np.hypot(np.hypot(spec.get("global_jitter_sigma", 0.0), spec.get("overlap_jitter_sigma", 0.0)), np.asarray(spec.get("feature_jitter_sigma", 0.0)))
    x, labels = x + rng.normal(size=x.shape) * sigma, np.unique(y)
    flip = rng.uniform(size=len(y)) < spec.get("label_flip_rate", 0.0)
    if len(labels) > 1 and flip.any():
        at = np.searchsorted(labels, y[flip])
        y = y.copy()
        y[flip] = labels[(at + rng.integers(1, len(labels), len(at))) % len(labels)]
    return x, y


def arrival_times(rng, x, y, spec):
    """One column becomes the running sum of another: arrivals from intervals, with missing and doubled ones."""
    pri, toa = int(spec.get("pri_dim", 0)), int(spec.get("toa_dim", 1))
    order = np.argsort(x[:, pri], kind="stable") if spec.get("sort_by_pri") else np.arange(len(x))
    x, y = x[order].copy(), y[order]
    x[:, toa] = spec.get("start_toa", 0.0) + np.cumsum(np.maximum(x[:, pri] * spec.get("pri_scale", 1.0), 1e-12)) + rng.normal(0, spec.get("toa_jitter_sigma", 0.0), len(x))
    x, y = _keep(x, y, rng.uniform(size=len(x)) >= spec.get("missing_rate", 0.0))
    if spec.get("duplicate_rate"):
        again = rng.uniform(size=len(x)) < spec["duplicate_rate"]
        twin = x[again].copy()
        twin[:, toa] += rng.normal(0, spec.get("duplicate_jitter_sigma", 0.0), len(twin))
        x, y = np.vstack((x, twin)), np.append(y, y[again])
    order = np.argsort(x[:, toa], kind="stable") if spec.get("sort_by_toa", True) else np.arange(len(x))
    return x[order], y[order]


#: In the order in which a dataset is perturbed.
PERTURBATIONS = {
    "size_imbalance": size_imbalance,
    "density_imbalance": density_imbalance,
    "dropout": lambda rng, x, y, share: _keep(x, y, rng.uniform(size=len(x)) >= share),
    "holes": holes,
    "bridges": bridges,
    "contamination": contamination,
    "duplicates": duplicates,
    "jitter": lambda rng, x, y, sigma: (x + rng.normal(size=x.shape) * np.asarray(sigma), y),
    "difficulty": difficulty,
    "arrival_times": arrival_times,
}


def perturb(rng, x: np.ndarray, y: np.ndarray, spec: dict) -> tuple[np.ndarray, np.ndarray]:
    """All perturbations of a spec in their order; unknown names are an error."""
    if unknown := set(spec) - set(PERTURBATIONS):
        raise ValueError(f"unknown perturbations: {sorted(unknown)}")
    for name, run in PERTURBATIONS.items():
        if spec.get(name) and len(x):
            x, y = run(rng, x, y, spec[name])
    return x, y
