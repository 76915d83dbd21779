"""Label-free descriptors of point clouds: value distribution (A), axes and density (B), relations (R).

Points: keys, point_id, x, y. All blocks are aggregations over the keys;
histograms are (key, bin) counts, so no cloud meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .summaries import q

EPS = 1e-12


def views(points: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Each cloud as its three decision views: x_only, y_only, xy_2d (SRC-02, SRC-03, FLT-01)."""
    view = lambda name, rank, *axes: F.struct(F.lit(name).alias("view_id"), F.lit(rank).alias("view_rank"), F.array(*map(F.col, axes)).alias("decision"))
    three = F.explode(F.array(view("x_only", 0, "x"), view("y_only", 1, "y"), view("xy_2d", 2, "x", "y"))).alias("v")
    return points.select(*keys, "point_id", "x", "y", three).select(*keys, "point_id", "x", "y", "v.*")


def flat_values(viewed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value) of all coordinates of a view."""
    return viewed.select(*keys, F.explode("decision").alias("value"))


def histogram(values: DataFrame, keys: Sequence[str], bins: int, value: str = "value") -> DataFrame:
    """(keys, bin, n) of equal bins over the range, the last edge closed (FN-11 in one dimension)."""
    span = values.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = F.col("_high") - F.col("_low")
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_low")) / width * bins), F.lit(bins - 1))).otherwise(bins // 2)
    placed = values.join(span, list(keys)) if keys else values.crossJoin(span)
    return placed.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def entropy(n: str, bins: int, keys: Sequence[str]) -> Column:
    """Entropy of counts over ln(bins), empty bins counted (FN-04); an aggregate."""
    share = F.col("_p")
    return -F.sum(F.when(share > 0, share * F.ln(share)).otherwise(0.0)) / F.ln(F.lit(float(bins)))


def histogram_features(values: DataFrame, keys: Sequence[str], bins: int, prefix: str) -> DataFrame:
    """Entropy, largest and empty share of a histogram."""
    counts = histogram(values, keys, bins).withColumn("_p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return counts.groupBy(*keys).agg(entropy("n", bins, keys).alias(f"{prefix}_entropy_hist_{bins}"), F.max("_p").alias(f"{prefix}_peak_bin_ratio_{bins}"), (1 - F.count("*") / bins).alias(f"{prefix}_empty_bin_ratio_{bins}"))


def moments(c: str) -> dict[str, Column]:
    """Guarded skewness and excess kurtosis, population form (FN-02, FN-03)."""
    flat = F.stddev_pop(c) < EPS
    return {"skew": F.when(F.count(c) < 3, None).when(flat, 0.0).otherwise(F.skewness(c)), "kurtosis": F.when(F.count(c) < 4, None).when(flat, 0.0).otherwise(F.kurtosis(c))}


def block_a(viewed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 30 value-distribution features of a view (MF-01, MF-02)."""
    p = "A_view"
    finite = F.forall("decision", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    shape = viewed.groupBy(*keys).agg(
        F.ln(1 + F.count("*")).alias(f"{p}_n_points_log1p"),
        F.max(F.size("decision")).alias(f"{p}_dim"),
        F.avg(finite.cast("double")).alias(f"{p}_finite_ratio"),
        (F.countDistinct(F.transform("decision", lambda v: F.bround(v, 6))) / F.count("*")).alias(f"{p}_unique_ratio_rounded_6"),
    ).withColumn(f"{p}_duplicate_ratio_rounded_6", 1 - F.col(f"{p}_unique_ratio_rounded_6"))
    values = flat_values(viewed, keys)
    m = moments("value")
    level = {name: q("value", at) for name, at in (("q01", 0.01), ("q05", 0.05), ("q25", 0.25), ("q75", 0.75), ("q95", 0.95), ("q99", 0.99), ("median", 0.5))}
    basic = values.groupBy(*keys).agg(
        F.avg("value").alias(f"{p}_mean_flat"), F.stddev_pop("value").alias(f"{p}_std_flat"), F.min("value").alias(f"{p}_min_flat"), F.max("value").alias(f"{p}_max_flat"), (F.max("value") - F.min("value")).alias(f"{p}_range_flat"),
        *(c.alias(f"{p}_{n}_flat") for n, c in level.items()), (level["q75"] - level["q25"]).alias(f"{p}_iqr_flat"), m["skew"].alias(f"{p}_skew_flat"), m["kurtosis"].alias(f"{p}_kurtosis_flat"),
    )
    near = values.join(basic, list(keys))
    v, col = F.col("value"), lambda n: F.col(f"{p}_{n}_flat")
    z = F.when(col("std") < EPS, 0.0).otherwise((v - col("mean")) / col("std"))
    share = lambda c: F.avg(c.cast("double"))
    tails = near.groupBy(*keys).agg(
        q(F.abs(v - col("median")), 0.5).alias(f"{p}_mad_flat"),
        share(v <= col("min") + 0.05 * col("range")).alias(f"{p}_tail_mass_low_5pct"),
        share(v >= col("min") + 0.95 * col("range")).alias(f"{p}_tail_mass_high_95pct"),
        share((v < col("q25") - 1.5 * col("iqr")) | (v > col("q75") + 1.5 * col("iqr"))).alias(f"{p}_outlier_ratio_iqr_1_5"),
        share(F.abs(z) > 3).alias(f"{p}_outlier_ratio_z_3"),
        F.avg(F.abs(z)).alias(f"{p}_mean_abs_zscore"),
    )
    h32 = histogram_features(values, keys, 32, p)
    h64 = histogram_features(values, keys, 64, p).select(*keys, f"{p}_entropy_hist_64")
    out = shape
    for part in (basic, tails, h32, h64):
        out = out.join(part, list(keys))
    return out


def density_grid(points: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Occupied share, entropy, largest share, CV, Gini and empty share of a bins x bins grid (MF-04)."""
    span = points.groupBy(*keys).agg(*(f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("l", F.min), ("h", F.max))))
    cell = lambda c: F.when(F.col(f"_h{c}") > F.col(f"_l{c}"), F.least(F.floor((F.col(c) - F.col(f"_l{c}")) / (F.col(f"_h{c}") - F.col(f"_l{c}")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = points.join(span, list(keys)).groupBy(*keys, cell("x").alias("i"), cell("y").alias("j")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    total = bins * bins
    ranked = counts.withColumns({"_p": F.col("n") / F.sum("n").over(whole), "_r": F.row_number().over(whole.orderBy("n", "i", "j")) + (total - F.count("*").over(whole))})
    mean = F.sum("n") / total
    return ranked.groupBy(*keys).agg(
        (F.count("*") / total).alias(f"occupied_ratio_{bins}"),
        entropy("n", total, keys).alias(f"entropy_{bins}"),
        F.max("_p").alias(f"max_cell_ratio_{bins}"),
        (F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("n")) / total - mean * mean)) / mean).alias(f"cv_{bins}"),
        (2 * F.sum(F.col("_r") * F.col("n")) / (total * F.sum("n")) - (total + 1) / total).alias(f"gini_{bins}"),
        (1 - F.count("*") / total).alias(f"empty_cell_ratio_{bins}"),
    )


def block_b(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axis, box, covariance, principal-axis, centroid-distance and grid features (MF-03)."""
    own = []
    for i, c in enumerate(("x", "y")):
        m = moments(c)
        own += [x.alias(f"B_axis{i}_{n}") for n, x in {"mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c), "max": F.max(c), "range": F.max(c) - F.min(c), "iqr": q(c, 0.75) - q(c, 0.25), **m}.items()]
    base = points.groupBy(*keys).agg(*own, F.count("*").alias("_n"), F.var_samp("x").alias("_vx"), F.var_samp("y").alias("_vy"), F.covar_samp("x", "y").alias("_c"), F.corr("x", "y").alias("B_corr_axis0_axis1"))
    w, h = F.col("B_axis0_range"), F.col("B_axis1_range")
    half = (F.col("_vx") + F.col("_vy")) / 2
    part = F.sqrt(F.pow((F.col("_vx") - F.col("_vy")) / 2, 2) + F.pow("_c", 2))
    big, small = half + part, F.greatest(half - part, F.lit(0.0))
    shaped = base.withColumns(
        {
            "B_bbox_area": w * h,
            "B_bbox_aspect_ratio": F.when(F.least(w, h) > EPS, F.greatest(w, h) / F.least(w, h)),
            "B_bbox_density_points_per_area": F.when(w * h > EPS, F.col("_n") / (w * h)),
            "B_cov_trace": F.col("_vx") + F.col("_vy"),
            "B_cov_det": F.col("_vx") * F.col("_vy") - F.col("_c") * F.col("_c"),
            "B_cov_condition_number": F.when(small > EPS, big / small),
            "B_abs_corr_axis0_axis1": F.abs("B_corr_axis0_axis1"),
            "B_pca_eigenvalue_1": big,
            "B_pca_eigenvalue_2": small,
            "B_pca_explained_ratio_1": F.when(half > EPS, big / (2 * half)),
            "B_pca_explained_ratio_2": F.when(half > EPS, small / (2 * half)),
            "B_pca_anisotropy_ratio": F.when(small > EPS, big / small),
            "B_centroid_norm": F.sqrt(F.pow("B_axis0_mean", 2) + F.pow("B_axis1_mean", 2)),
        }
    ).drop("_n", "_vx", "_vy", "_c")
    d = F.sqrt(F.pow(F.col("x") - F.col("B_axis0_mean"), 2) + F.pow(F.col("y") - F.col("B_axis1_mean"), 2))
    far = points.join(shaped.select(*keys, "B_axis0_mean", "B_axis1_mean"), list(keys)).withColumn("_d", d)
    distances = far.groupBy(*keys).agg(F.avg("_d").alias("B_mean_distance_to_centroid"), F.stddev_pop("_d").alias("B_std_distance_to_centroid"), *(q("_d", a / 100).alias(f"B_q{a}_distance_to_centroid") for a in (25, 50, 75, 90)))
    g16, g32 = density_grid(points, keys, 16), density_grid(points, keys, 32)
    names = ("occupied_ratio", "entropy", "max_cell_ratio")
    g16 = g16.select(*keys, *(F.col(f"{n}_16").alias(f"B_density_grid_16_{n}") for n in names))
    g32 = g32.select(*keys, *(F.col(f"{n}_32").alias(f"B_density_grid_32_{n}") for n in names), *(F.col(f"{n}_32").alias(f"B_density_grid_{n}") for n in ("cv", "gini", "empty_cell_ratio")))
    return shaped.join(distances, list(keys)).join(g16, list(keys)).join(g32, list(keys))


def mutual_information(points: DataFrame, keys: Sequence[str], bins: int = 16) -> DataFrame:
    """MI of x and y from the joint histogram, natural log (FN-11, FN-12)."""
    span = points.groupBy(*keys).agg(*(f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("l", F.min), ("h", F.max))))
    cell = lambda c: F.when(F.col(f"_h{c}") > F.col(f"_l{c}"), F.least(F.floor((F.col(c) - F.col(f"_l{c}")) / (F.col(f"_h{c}") - F.col(f"_l{c}")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    joint = points.join(span, list(keys)).groupBy(*keys, cell("x").alias("i"), cell("y").alias("j")).agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy(*keys, *by))
    full = joint.withColumns({"_t": over(), "_a": over("i"), "_b": over("j")})
    return full.groupBy(*keys).agg(F.sum(F.col("n") / F.col("_t") * F.ln(F.col("n") * F.col("_t") / (F.col("_a").cast("double") * F.col("_b")))).alias("mutual_information"))


def relations(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Linear and rank relations of the axes (part of MF-17; FN-10, FN-16, FN-18)."""
    order = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, "point_id"))
    ranked = points.withColumns({"_rx": order("x"), "_ry": order("y")})
    return ranked.groupBy(*keys).agg(F.corr("x", "y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman_positional"), F.regr_r2("y", "x").alias("linear_r2"), F.regr_slope("y", "x").alias("slope"))


def conditional_variance(points: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean variance of y within bins of x of equal counts, and the sign share of the bins' median steps (FN-20, FN-21)."""
    binned = points.withColumn("_b", F.ntile(bins).over(Window.partitionBy(*keys).orderBy("x", "point_id")))
    per = binned.groupBy(*keys, "_b").agg(F.var_pop("y").alias("_v"), q("y", 0.5).alias("_m"))
    step = F.col("_m") - F.lag("_m").over(Window.partitionBy(*keys).orderBy("_b"))
    moved = per.withColumn("_s", step)
    up, down = F.count_if(F.col("_s") > 0), F.count_if(F.col("_s") < 0)
    return moved.groupBy(*keys).agg(F.avg("_v").alias("conditional_variance"), F.when(F.count("_s") > 0, F.greatest(up, down) / F.count("_s")).otherwise(0.0).alias("monotonicity"))


def gini(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Gini coefficient of absolute values (FN-05)."""
    whole = Window.partitionBy(*keys)
    ranked = values.withColumn("_a", F.abs(value)).withColumns({"_r": F.row_number().over(whole.orderBy("_a")), "_n": F.count("*").over(whole)})
    return ranked.groupBy(*keys).agg(F.when(F.sum("_a") > 0, 2 * F.sum(F.col("_r") * F.col("_a")) / (F.max("_n") * F.sum("_a")) - (F.max("_n") + 1) / F.max("_n")).otherwise(0.0).alias("gini"))


def complete(record: DataFrame) -> DataFrame:
    """No empty cell: 0.0, 'unknown', -1 or false by type (MF-20)."""
    fill = {"double": F.lit(0.0), "float": F.lit(0.0), "string": F.lit("unknown"), "int": F.lit(-1), "bigint": F.lit(-1), "boolean": F.lit(False)}
    return record.select(*(F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")) if t == "double" else F.col(c), fill[t]).alias(c) if t in fill else F.col(c) for c, t in record.dtypes))
