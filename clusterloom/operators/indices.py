"""Validity indices that are relational: a labelled point frame in, a row per key out.

Points: keys, point_id, x, y, label. Noise (-1) is dropped first. Centroid and
moment indices are two aggregations. Pair indices compare points of one key
through grid cells or within NumPy tasks and are marked so.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import plane, tiles

NOISE = -1
#: Points of a key that one NumPy task compares in pairs; larger clouds are compared in tiles.
MAX_PAIRWISE = 20_000
#: Clusters of a partition whose sums are a product with indicators; rows whose sums are held; rows and columns of a step.
PRODUCT, ROWS, STEPS = 32, 8_192, (256, 2_048)


def clustered(points: DataFrame) -> DataFrame:
    """Points that are not noise (FLT-02)."""
    return points.filter(F.col("label") != NOISE)


def clusters(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, label, n, cx, cy, ss): centroid and squared spread of each cluster; a small table."""
    return clustered(points).groupBy(*keys, "label").agg(
        F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), ((F.var_pop("x") + F.var_pop("y")) * F.count("*")).alias("ss"),
        F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"),
    )


def _to_centroid(points: DataFrame, own: DataFrame, keys: Sequence[str]) -> DataFrame:
    near = own.select(*keys, "label", "cx", "cy")
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    return clustered(points).join(near, [*keys, "label"]).withColumn("d", d)


def _centroid_pairs(own: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    a = own.select(*keys, "label", "cx", "cy", *more)
    b = own.select(*keys, F.col("label").alias("label_b"), F.col("cx").alias("cx_b"), F.col("cy").alias("cy_b"), *(F.col(c).alias(f"{c}_b") for c in more))
    met = a.join(b, list(keys)) if keys else a.crossJoin(b)  # clusters, not points
    return met.filter("label <> label_b").withColumn("gap", F.sqrt(F.pow(F.col("cx") - F.col("cx_b"), 2) + F.pow(F.col("cy") - F.col("cy_b"), 2)))


def calinski_harabasz(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CVI-02: between over within spread, each over its degrees of freedom."""
    whole = clustered(points).groupBy(*keys).agg(F.count("*").alias("n"), ((F.var_pop("x") + F.var_pop("y")) * F.count("*")).alias("all_ss"), F.countDistinct("label").alias("k"))
    within = clusters(points, keys).groupBy(*keys).agg(F.sum("ss").alias("within"))
    joined = whole.join(within, list(keys)) if keys else whole.crossJoin(within)
    ch = ((F.col("all_ss") - F.col("within")) / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return joined.select(*keys, F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("within") > 0), ch).alias("raw"))


def davies_bouldin(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CVI-03: mean over clusters of the worst ratio of scatter to centroid distance."""
    own = clusters(points, keys)
    scatter = _to_centroid(points, own, keys).groupBy(*keys, "label").agg(F.avg("d").alias("s"))
    pairs = _centroid_pairs(own.join(scatter, [*keys, "label"]), keys, "s")
    worst = pairs.groupBy(*keys, "label").agg(F.max(F.when(F.col("gap") > 0, (F.col("s") + F.col("s_b")) / F.col("gap")).otherwise(0.0)).alias("w"))
    return worst.groupBy(*keys).agg(F.avg("w").alias("raw"))


def size_entropy(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CVI-08 and CVI-09: normalised entropy of the cluster sizes, and what it lacks to 1."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    entropy = F.when(F.count("*") > 1, -F.sum(F.col("p") * F.ln("p")) / F.ln(F.count("*"))).otherwise(0.0)
    sizes = clustered(points).groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return sizes.withColumn("p", p).groupBy(*keys).agg(entropy.alias("balance")).withColumn("imbalance", 1 - F.col("balance"))


def min_centroid_distance(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CVI-14."""
    return _centroid_pairs(clusters(points, keys), keys).groupBy(*keys).agg(F.min("gap").alias("raw"))


def within_dispersion(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CVI-13: mean over clusters of the mean distance to the centroid."""
    per = _to_centroid(points, clusters(points, keys), keys).groupBy(*keys, "label").agg(F.avg("d").alias("s"))
    return per.groupBy(*keys).agg(F.avg("s").alias("raw"))


def _eigen() -> tuple[Column, Column]:
    half, part = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow(F.col("vxy"), 2))

    return half + part, F.greatest(half - part, F.lit(0.0))


def isotropy(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CVI-07: mean over clusters of the smaller over the larger eigenvalue."""
    own = clusters(points, keys).filter("n >= 3")
    big, small = _eigen()
    return own.groupBy(*keys).agg(F.avg(F.when(big > 0, small / big).otherwise(0.0)).alias("raw"))


def eccentricity(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CVI-34: size-weighted mean of 1 - exp(-sqrt(l1/l2)/2)."""
    own = clusters(points, keys).filter("n >= 3")
    big, small = _eigen()
    value = F.when(small > 1e-12, 1 - F.exp(-F.sqrt(big / small) / 2)).otherwise(1.0)
    return own.groupBy(*keys).agg((F.sum(F.col("n") * value) / F.sum("n")).alias("raw"))


def s_dbw(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CVI-05: scattering plus density between centroids (ddof 1)."""
    own = clusters(points, keys)
    spread = lambda: F.sqrt(F.pow("vx", 2) + F.pow("vy", 2))
    whole = clustered(points).groupBy(*keys).agg(F.var_samp("x").alias("gx"), F.var_samp("y").alias("gy"))
    per = own.groupBy(*keys).agg(F.avg(spread()).alias("mean_spread"), (F.sqrt(F.sum(spread())) / F.count("*")).alias("radius"))
    base = per.join(whole, list(keys)) if keys else per.crossJoin(whole)
    middle = _centroid_pairs(own, keys).filter("label < label_b").withColumns({"mx": (F.col("cx") + F.col("cx_b")) / 2, "my": (F.col("cy") + F.col("cy_b")) / 2})
    spots = middle.select(*keys, F.col("label").alias("la"), F.col("label_b").alias("lb"), "cx", "cy", "cx_b", "cy_b", "mx", "my")
    spots = spots.join(base.select(*keys, "radius"), list(keys)) if keys else spots.crossJoin(base.select("radius"))
    # Each point meets the pairs of its own cluster only.
    ends = F.explode(F.array("la", "lb")).alias("label")
    facing = clustered(points).join(spots.select("*", ends), [*keys, "label"])
    near = lambda a, b: F.count_if(F.sqrt(F.pow(F.col("x") - F.col(a), 2) + F.pow(F.col("y") - F.col(b), 2)) <= F.col("radius"))
    density = facing.groupBy(*keys, "la", "lb").agg(near("mx", "my").alias("m"), near("cx", "cy").alias("a"), near("cx_b", "cy_b").alias("b"))
    most = F.greatest("a", "b")
    between = density.groupBy(*keys).agg(F.avg(F.when(most > 0, F.col("m") / most).otherwise(0.0)).alias("dens"))
    joined = base.join(between, list(keys)) if keys else base.crossJoin(between)
    scale = F.sqrt(F.pow("gx", 2) + F.pow("gy", 2))
    return joined.select(*keys, (F.when(scale > 0, F.col("mean_spread") / scale).otherwise(0.0) + F.col("dens")).alias("raw"))


def split_large(points: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Points of the keys with at most so many, and those of the others, written once as many passes read them; None where there are none."""
    large = points.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    if not large.limit(1).count():
        return points, None
    if not keys:
        return points.limit(0), written(points, "large")
    large = large.select(*keys)
    return points.join(large, list(keys), "left_anti"), written(points.join(large, list(keys), "left_semi"), "large")


def _pairwise(name: str, kernel, whole):
    """kernel: of clouds that one task compares, up to MAX_PAIRWISE points. whole: a plan for larger ones."""

    def make(points: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
        names = list(keys)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("point_id")
            raw = kernel(rows[["x", "y"]].to_numpy(float), rows["label"].to_numpy(), **options)
            return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in names}, "raw": [raw]})

        own = clustered(points).select(*names, "point_id", "x", "y", "label")
        ddl = ", ".join([*(f"{k} {own.schema[k].dataType.simpleString()}" for k in names), "raw double"])
        small, large = split_large(own, names, MAX_PAIRWISE)
        out = small.groupBy(*(names or [F.lit(1).alias("_one")])).applyInPandas(run, ddl)
        return out if large is None else out.unionByName(whole(large, names, **options).select(*names, "raw"))

    make.__name__ = name
    make.__doc__ = kernel.__doc__
    return make


def _blocks(x: np.ndarray, step: int = 512):
    for i in range(0, len(x), step):
        yield i, np.sqrt(((x[i : i + step, None, :] - x[None, :, :]) ** 2).sum(2))


def _listed(x: np.ndarray, most: int) -> np.ndarray:
    """Positions of the nearest other points by all distances, which may be missing."""
    near = []
    for i, d in _blocks(x):
        at = np.arange(len(d))
        d[at, i + at] = np.inf
        near.append(np.argsort(d, 1, kind="stable")[:, :most])
    return np.concatenate(near)


def silhouette_kernel(x: np.ndarray, labels: np.ndarray) -> float | None:
    """CVI-01: mean silhouette, euclidean; singletons count 0."""
    return silhouettes(x, [np.unique(labels, return_inverse=True)[1]])[0]


def silhouettes(x: np.ndarray, partitions: Sequence[np.ndarray]) -> list[float | None]:
    """Mean silhouettes of several partitions of one cloud from one pass over its distances; negative labels are left out."""
    return [total / n if n else None for total, n in silhouette_sums(x, partitions, 0, len(x))]


def silhouette_sums(x: np.ndarray, partitions: Sequence[np.ndarray], start: int, stop: int) -> list[tuple[float, int]]:
    """(sum of silhouettes, number) of the points start to stop for each partition; a single cluster gives (0, 0).

    Sums of distances to clusters are products with their indicators, or for
    partitions of more than PRODUCT clusters sums over points dealt by cluster.
    Memory grows with the points and with STEP.
    """
    parts, product, runs, columns = [], [], [], 0
    for labels in partitions:
        inside = np.asarray(labels) >= 0
        codes = np.full(len(x), -1)
        codes[inside] = np.unique(np.asarray(labels)[inside], return_inverse=True)[1]
        sizes = np.bincount(codes[inside])
        parts.append((codes, sizes, slice(columns, columns + len(sizes))) if len(sizes) > 1 else None)
        if parts[-1]:
            (product if len(sizes) <= PRODUCT else runs).append(parts[-1])
            columns += len(sizes)
    found = [[0.0, 0] for _ in parts]
    if not columns:
        return [(0.0, 0) for _ in parts]
    at_product = np.concatenate([np.arange(at.start, at.stop) for _, _, at in product]) if product else None
    rows_of = max(STEPS[0], min(ROWS, plane.STEP // columns))
    for low in range(start, stop, rows_of):
        high = min(stop, low + rows_of)
        sums = np.zeros((columns, high - low))
        for c in range(0, len(x), STEPS[1]):
            there = slice(c, min(len(x), c + STEPS[1]))
            one = np.concatenate([(codes[None, there] == np.arange(len(sizes))[:, None]) for codes, sizes, _ in product]).astype(float) if product else None
            dealt = []
            for codes, _, at in runs:
                order = np.argsort(codes[there], kind="stable")
                order = order[codes[there][order] >= 0]
                own, first = np.unique(codes[there][order], return_index=True)
                dealt.append((order, first, at.start + own))
            for r in range(low, high, STEPS[0]):
                here = slice(r - low, min(high, r + STEPS[0]) - low)
                d = plane.between(x[there], x[low + here.start : low + here.stop])
                if product:
                    sums[at_product, here] += one @ d
                for order, first, own in dealt:
                    if len(order):
                        sums[own, here] += np.add.reduceat(d[order], first, axis=0)
        for p, part in enumerate(parts):
            if part:
                codes, sizes, at = part
                rows = np.flatnonzero(codes[low:high] >= 0)
                own, own_sums = codes[low:high][rows], sums[at, rows].T
                i = np.arange(len(rows))
                a = own_sums[i, own] / np.maximum(sizes[own] - 1, 1)
                means = own_sums / sizes
                means[i, own] = np.inf
                b = means.min(1)
                found[p][0] += float(np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum())
                found[p][1] += len(rows)
    return [(total, n) for total, n in found]


def purity_kernel(x: np.ndarray, labels: np.ndarray, ks: tuple[int, ...] = (10,)) -> float | None:
    """CVI-10 and CVI-11: share of the nearest neighbours with the point's label, mean over the sizes."""
    if len(x) < 2:
        return None
    most = min(max(ks), len(x) - 1)
    near = plane.Plane(x).neighbours(most)[0] if np.isfinite(x).all() else _listed(x, most)
    same = labels[near] == labels[:, None]
    return float(np.mean([same[:, : min(k, most)].mean(1).sum() / len(x) for k in ks]))


def min_distance_kernel(x: np.ndarray, labels: np.ndarray) -> float | None:
    """CVI-12: least distance between points of different clusters."""
    if np.isfinite(x).all():
        least = plane.least_between(x, labels)
    else:
        least = min((float(np.where(labels[i : i + len(d), None] == labels[None, :], np.inf, d).min()) for i, d in _blocks(x)), default=np.inf)
    return None if np.isinf(least) else least


def dunn_kernel(x: np.ndarray, labels: np.ndarray) -> float | None:
    """BL-01: least distance between clusters over the largest diameter."""
    least, most = np.inf, 0.0
    for i, d in _blocks(x):
        same = labels[i : i + len(d), None] == labels[None, :]
        most = max(most, float(d[same].max(initial=0.0)))
        least = min(least, float(np.where(same, np.inf, d).min()))
    return float(least / most) if most > 0 and np.isfinite(least) else None


silhouette = _pairwise("silhouette", silhouette_kernel, tiles.silhouette)
neighborhood_purity = _pairwise("neighborhood_purity", purity_kernel, tiles.neighborhood_purity)
min_intercluster_distance = _pairwise("min_intercluster_distance", min_distance_kernel, tiles.min_intercluster_distance)
dunn = _pairwise("dunn", dunn_kernel, tiles.dunn)


def noise_aware_silhouette(points: DataFrame, keys: Sequence[str] = (), alpha: float = 1.0) -> DataFrame:
    """CVI-06: silhouette of the clustered points times (1 - noise ratio) ^ alpha."""
    noise = points.groupBy(*keys).agg(F.avg((F.col("label") == NOISE).cast("double")).alias("_noise"))
    own = silhouette(points, keys)
    joined = own.join(noise, list(keys)) if keys else own.crossJoin(noise)
    return joined.select(*keys, (F.col("raw") * F.pow(1 - F.col("_noise"), F.lit(alpha))).alias("raw"))


def normalise(metric: str, raw: Column, n_samples: Column | None = None, scale: float = 1.0) -> Column:
    """The squash of each index to [0, 1]; NULL or non-finite values give 0 (OBJ-02, OBJ-04)."""
    up = F.greatest(F.lit(0.0), raw)
    if metric in ("silhouette", "noise_aware_silhouette", "dbcv"):
        value = (raw + 1) / 2
    elif metric == "calinski_harabasz":
        s, c = F.ln(1 + up), F.ln(1 + F.greatest(F.lit(2), n_samples if n_samples is not None else F.lit(2)))
        value = s / (s + c)
    elif metric in ("davies_bouldin", "s_dbw"):
        value = 1 / (1 + up)
    elif metric in ("min_intercluster_distance", "min_centroid_distance"):
        value = 1 - F.exp(-up / scale)
    elif metric == "avg_within_cluster_dispersion":
        value = F.exp(-up / scale)
    else:
        value = raw
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(~F.isnan(raw), value))), F.lit(0.0))
