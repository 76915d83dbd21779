"""Density and separation indices of partitions in NumPy: DBCV, CDbw, CVDD, DCSI, COP and Coggins-Jain."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, plane, tiles
from .contours import hull
from .indices import clustered, split_large
from .kernels import distances, in_blocks, mst
from .search import spread

#: Points of a key that one task compares, beyond kernels.MATRIX_POINTS in blocks of the plane; larger clouds are compared in tiles.
MOST_POINTS = 400_000


def _parts(labels: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(labels == c) for c in np.unique(labels)]


def _core(d: np.ndarray, dim: int) -> np.ndarray:
    """Core distance of each point from its own cluster's points."""
    with np.errstate(divide="ignore"):
        inverse = np.where(d > 0, 1 / d, 0.0) ** dim
    return np.maximum(inverse.sum(1) / max(1, len(d) - 1), 1e-300) ** (-1 / dim)


def dbcv(x: np.ndarray, labels: np.ndarray) -> float | None:
    """CVI-04: density sparseness within against density separation between clusters, weighted by size."""
    parts = [p for p in _parts(labels) if len(p) > 2]
    if len(parts) < 2:
        return None
    if in_blocks(x):
        return _dbcv_in_blocks(x, labels, parts)
    d = distances(x)
    core = np.zeros(len(x))
    for p in parts:
        core[p] = _core(d[np.ix_(p, p)], x.shape[1])
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    sparse, inner = [], []
    for p in parts:
        edges = mst(reach[np.ix_(p, p)])
        degree = np.bincount([i for _, a, b in edges for i in (a, b)], minlength=len(p))
        inside = [e for e, a, b in edges if degree[a] > 1 and degree[b] > 1]
        sparse.append(max(inside or [e for e, _, _ in edges]))
        inner.append(p[degree > 1] if (degree > 1).any() else p)
    total = 0.0
    for i, p in enumerate(parts):
        apart = min(reach[np.ix_(inner[i], inner[j])].min() for j in range(len(parts)) if j != i)
        total += len(p) / len(x) * (apart - sparse[i]) / max(apart, sparse[i], 1e-300)
    return float(total)


def _core_in_blocks(x: np.ndarray) -> np.ndarray:
    """_core() of all distances of a cluster, a few rows at a time."""
    total, step = np.zeros(len(x)), max(1, plane.STEP // (8 * len(x)))
    for i in range(0, len(x), step):
        d = plane.between(x[i : i + step], x)
        with np.errstate(divide="ignore"):
            np.divide(1.0, d, out=d)
        d[np.isinf(d)] = 0.0
        total[i : i + step] = np.einsum("ij,ij->i", d, d) if x.shape[1] == 2 else (d ** x.shape[1]).sum(1)
    return np.maximum(total / max(1, len(x) - 1), 1e-300) ** (-1 / x.shape[1])


def _dbcv_in_blocks(x: np.ndarray, labels: np.ndarray, parts: list[np.ndarray]) -> float:
    core, sparse, inner = np.zeros(len(x)), [], []
    for p in parts:
        core[p] = _core_in_blocks(x[p])
        edges = plane.spanning_tree(x[p], core[p])
        degree = np.bincount([i for _, a, b in edges for i in (a, b)], minlength=len(p))
        inside = [e for e, a, b in edges if degree[a] > 1 and degree[b] > 1]
        sparse.append(max(inside or [e for e, _, _ in edges]))
        inner.append(p[degree > 1] if (degree > 1).any() else p)
    kept = np.concatenate(inner)
    apart = plane.least_apart(x[kept], labels[kept], core[kept])
    return float(sum(len(p) / len(x) * (a - s) / max(a, s, 1e-300) for p, a, s in zip(parts, apart.tolist(), sparse, strict=True)))


def cop(x: np.ndarray, labels: np.ndarray) -> float | None:
    """BL-01: mean distance to the centroid over the least greatest distance to a point outside; lower is better."""
    parts, blocks = _parts(labels), in_blocks(x)
    if len(parts) < 2:
        return None
    d, out = None if blocks else distances(x), 0.0
    for p in parts:
        rest = np.setdiff1d(np.arange(len(x)), p)
        # The farthest point of a cluster is a corner of its hull.
        far = min(float(plane.between(x[rest[i : i + 4096]], corners).max(1).min()) for i in range(0, len(rest), 4096)) if blocks and len(corners := hull(x[p])) else d[np.ix_(rest, p)].max(1).min()
        out += len(p) * np.linalg.norm(x[p] - x[p].mean(0), axis=1).mean() / max(far, 1e-300)
    return float(out / len(x))


def coggins_jain(x: np.ndarray, labels: np.ndarray) -> float | None:
    """BL-01: least ratio of centroid distance to the largest distance within."""
    parts = _parts(labels)
    if len(parts) < 2:
        return None
    c = np.array([x[p].mean(0) for p in parts])
    gap = distances(c)
    np.fill_diagonal(gap, np.inf)
    wide = np.array([np.linalg.norm(x[p] - m, axis=1).max() for p, m in zip(parts, c, strict=True)])
    return float((gap.min(1) / np.maximum(wide, 1e-300)).min())


def _representatives(z: np.ndarray, n: int = 10) -> np.ndarray:
    """Far-apart points of a cluster, the first farthest from its centre."""
    chosen = [int(np.linalg.norm(z - z.mean(0), axis=1).argmax())]
    d = np.linalg.norm(z - z[chosen[0]], axis=1)
    while len(chosen) < min(n, len(z)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(z - z[chosen[-1]], axis=1))
    return z[chosen]


def cdbw(x: np.ndarray, labels: np.ndarray) -> float | None:
    """BL-10: cohesion times separation times compactness, from shrunken representatives."""
    own = [x[p] for p in _parts(labels)]
    if len(own) < 2:
        return None
    reps = [_representatives(z) for z in own]
    spread = np.array([np.sqrt(z.var(0).sum()) for z in own])
    mean_spread = max(float(np.sqrt((spread**2).mean())), 1e-300)
    separation, between = [], []
    for i in range(len(own)):
        near = []
        for j in range(len(own)):
            if i != j:
                d = distances(reps[i], reps[j])
                mutual = [(a, b) for a, b in zip(range(len(reps[i])), d.argmin(1), strict=True) if d[:, b].argmin() == a]
                gap = float(np.mean([d[a, b] for a, b in mutual]))
                both, half = np.concatenate((own[i], own[j])), (spread[i] + spread[j]) / 2
                count = np.mean([(np.linalg.norm(both - (reps[i][a] + reps[j][b]) / 2, axis=1) <= half).mean() for a, b in mutual])
                near.append((gap, gap / max(2 * half, 1e-300) * count))
        separation.append(min(g for g, _ in near))
        between.append(max(t for _, t in near))
    steps = np.arange(0.1, 0.9, 0.1)
    inside = [np.mean([np.mean([(np.linalg.norm(z - (r + s * (z.mean(0) - r)), axis=1) <= mean_spread).mean() for r in rep]) for z, rep in zip(own, reps, strict=True)]) / mean_spread for s in steps]
    compact = float(np.mean(inside))
    cohesion = compact / (1 + float(np.abs(np.diff(inside)).mean()))
    return float(cohesion * compact * np.mean(separation) / (1 + np.mean(between)))


def _minimax(d: np.ndarray) -> np.ndarray:
    """Least largest step between all points, from the spanning tree."""
    n, out, group = len(d), np.zeros_like(d), [[i] for i in range(len(d))]
    where = np.arange(n)
    for e, a, b in mst(d):
        ga, gb = where[a], where[b]
        out[np.ix_(group[ga], group[gb])] = e
        out[np.ix_(group[gb], group[ga])] = e
        where[group[gb]] = ga
        group[ga] = group[ga] + group[gb]
    return out


def cvdd(x: np.ndarray, labels: np.ndarray, k: int = 7) -> float | None:
    """BL-11: separation over compactness in minimax paths of density-weighted distances."""
    parts = _parts(labels)
    if len(parts) < 2:
        return None
    if in_blocks(x):
        local = plane.Plane(x).neighbours(k)[1].mean(1)
        return tiles.separation_in_tree(plane.spanning_tree(x, local / max(local.max(), 1e-300), tiles.stretched), labels)
    d = distances(x)
    local = np.sort(d, 1)[:, 1 : k + 1].mean(1)
    factor = local / max(local.max(), 1e-300)
    path = _minimax(d + np.sqrt(factor[:, None] * factor[None, :]) * d)
    total = 0.0
    for p in parts:
        rest = np.setdiff1d(np.arange(len(x)), p)
        within = path[np.ix_(p, p)]
        total += path[np.ix_(p, rest)].min() / max(within.mean() * (1 + within.std()), 1e-300) if len(p) > 1 else 0.0
    return float(total / len(parts))


def dcsi(x: np.ndarray, labels: np.ndarray, min_points: int = 5) -> float | None:
    """BL-12: mean over pairs of separation against connectedness of the core points."""
    parts, blocks = _parts(labels), in_blocks(x)
    d, cores, joined = None if blocks else distances(x), [], []
    for p in parts:
        if len(p) <= min_points:
            continue
        if blocks:
            near = plane.Plane(x[p]).neighbours(2 * min_points)[1]
            core = p[near[:, min_points - 1] <= np.median(near[:, -1])]
            if len(core) > 1:
                cores.append(core)
                joined.append(max(e for e, _, _ in plane.spanning_tree(x[core], np.zeros(len(core)))))
            continue
        own = d[np.ix_(p, p)]
        eps = float(np.median(np.sort(own, 1)[:, min(2 * min_points, len(p) - 1)]))
        core = p[(own <= eps).sum(1) > min_points]
        if len(core) > 1:
            cores.append(core)
            joined.append(max(e for e, _, _ in mst(d[np.ix_(core, core)])))
    if len(cores) < 2:
        return None
    out = []
    for i in range(len(cores)):
        for j in range(i):
            both = np.concatenate((cores[i], cores[j]))
            gap = plane.least_between(x[both], labels[both]) if blocks else d[np.ix_(cores[i], cores[j])].min()
            q = gap / max(joined[i], joined[j], 1e-300)
            out.append(q / (1 + q))
    return float(np.mean(out))


DENSITY = {"dbcv": dbcv, "cop": cop, "coggins_jain": coggins_jain, "cdbw": cdbw, "cvdd": cvdd, "dcsi": dcsi}
#: Indices that are better when smaller (BL-07).
SMALLER_IS_BETTER = ("cop", "davies_bouldin", "s_dbw", "avg_within_cluster_dispersion")


#: Plans for clouds beyond MOST_POINTS, and indices whose memory grows with the points alone, at any size in one task.
WHOLE = {"dbcv": tiles.dbcv, "cop": tiles.cop, "cvdd": tiles.cvdd, "dcsi": tiles.dcsi}
LINEAR = ("cdbw", "coggins_jain")


def density_indices(points: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """(keys, metric_id, raw, oriented): oriented is higher-is-better (BL-07, BL-14).

    A task holds one partition of up to kernels.MATRIX_POINTS, or one index of
    up to MOST_POINTS, in memory that grows with the points; larger ones are
    compared in tiles (WHOLE).
    """
    chosen, own = list(names or DENSITY), list(keys)
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in own)
    ddl = ", ".join(filter(None, (kinds, "metric_id string, raw double, oriented double")))

    def scored(some: Sequence[str]):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("point_id")
            x, labels = rows[["x", "y"]].to_numpy(float), rows["label"].to_numpy()
            raw = [DENSITY[n](x, labels) for n in some]
            oriented = [None if v is None else -v if n in SMALLER_IS_BETTER else v for n, v in zip(some, raw, strict=True)]
            return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(some) for k in own}, "metric_id": list(some), "raw": pd.Series(raw, dtype="float64"), "oriented": pd.Series(oriented, dtype="float64")})

        return run

    kept = clustered(points).select(*own, "point_id", "x", "y", "label")
    small, large = split_large(kept, own, min(kernels.MATRIX_POINTS, MOST_POINTS))
    by = own or [F.lit(1).alias("_one")]
    out = small.groupBy(*by).applyInPandas(scored(chosen), ddl)
    if large is None:
        return out
    middle, large = split_large(large, own, MOST_POINTS)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return scored([rows["_index"].iloc[0]])(rows)

    each = spread(middle.withColumn("_index", F.explode(F.array(*map(F.lit, chosen)))), *own, "_index")
    out = out.unionByName(each.groupBy(*own, "_index").applyInPandas(one, ddl))
    if large is None:
        return out
    linear = [n for n in chosen if n in LINEAR]
    if linear:
        out = out.unionByName(large.groupBy(*by).applyInPandas(scored(linear), ddl))
    for n in chosen:
        if n in WHOLE:
            sign = -1 if n in SMALLER_IS_BETTER else 1
            out = out.unionByName(WHOLE[n](large, own).select(*own, F.lit(n).alias("metric_id"), "raw", (sign * F.col("raw")).alias("oriented")))
    return out


def cvnn_parts(x: np.ndarray, labels: np.ndarray, k: int = 5) -> tuple[float, float] | None:
    """Separation and compactness of BL-13: the largest mean share of a cluster's k nearest neighbours that lie outside,
    and the sum over clusters of the mean distance within. Equal distances by position; singletons have distance 0."""
    if len(x) < 2:
        return None
    outside, inner = np.zeros(len(x)), 0.0
    most = min(k, len(x) - 1)
    if in_blocks(x):
        near = plane.Plane(x).neighbours(most)[0]
        outside = (labels[near] != labels[:, None]).mean(1)
        found = [(outside[p].mean(), plane.distance_sum(x[p]) / max(len(p) * (len(p) - 1), 1)) for p in _parts(labels)]
        return float(max(o for o, _ in found)), float(sum(c for _, c in found))
    for a in range(0, len(x), 512):
        d = distances(x[a : a + 512], x)
        at = np.arange(len(d))
        d[at, a + at] = np.inf
        near = np.argsort(d, 1, kind="stable")[:, :most]
        outside[a : a + len(d)] = (labels[near] != labels[a : a + len(d), None]).mean(1)
        for c in np.unique(labels[a : a + len(d)]):
            own = labels[a : a + len(d)] == c
            n = (labels == c).sum()
            within = d[np.ix_(own, labels == c)]
            inner += within[np.isfinite(within)].sum() / max(n * (n - 1), 1)
    return float(max(outside[labels == c].mean() for c in np.unique(labels))), float(inner)


def _cvnn_large(points: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    names = list(keys)
    blocks = tiles.blocks_of(points, names)
    near = tiles.neighbours(blocks, names, k)
    out = near.groupBy(*names, "label", "point_id").agg(F.avg((F.col("label") != F.col("other_label")).cast("double")).alias("o"))
    sep = out.groupBy(*names, "label").agg(F.avg("o").alias("o")).groupBy(*names).agg(F.max("o").alias("sep"))
    within = tiles.point_sums(points, names, blocks, tiles.distances_within)
    own = points.select(*names, F.col("point_id").cast("long").alias("point_id"), "label").join(within, [*names, "point_id"])
    each = own.groupBy(*names, "label").agg(F.sum("total").alias("t"), F.count("*").alias("n"))
    com = each.groupBy(*names).agg(F.sum(F.col("t") / F.greatest(F.lit(1), F.col("n") * (F.col("n") - 1))).alias("com"))
    return sep.join(com, names)


def cvnn(points: DataFrame, keys: Sequence[str], candidate: str, k: int = 5) -> DataFrame:
    """(keys, candidate, sep, com, raw): BL-13 of each candidate partition, relative to the others of its key; lower is better.

    points: keys, candidate, point_id, x, y, label. Partitions with fewer than
    two clusters without noise have no value, but count for the maxima.
    """
    names = [*keys, candidate]
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in names)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        found = cvnn_parts(rows[["x", "y"]].to_numpy(float), rows["label"].to_numpy(), k)
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in names}, "sep": [found and found[0]], "com": [found and found[1]]}).astype({"sep": "float64", "com": "float64"})

    kept = clustered(points).select(*names, "point_id", "x", "y", "label")
    small, large = split_large(kept, names, MOST_POINTS)
    parts = spread(small, *names).groupBy(*names).applyInPandas(run, f"{kinds}, sep double, com double")
    if large is not None:
        parts = parts.unionByName(_cvnn_large(large, names, k))
    count = kept.groupBy(*names).agg(F.countDistinct("label").alias("_k"))
    over = Window.partitionBy(*keys)
    value = F.col("sep") / F.nullif(F.max("sep").over(over), F.lit(0.0)) + F.col("com") / F.nullif(F.max("com").over(over), F.lit(0.0))
    return parts.withColumn("_v", value).join(count, names).select(*names, "sep", "com", F.when(F.col("_k") > 1, F.col("_v")).alias("raw"))
