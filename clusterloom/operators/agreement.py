"""Agreement of a partition with the truth, from the contingency table.

Long label frames: keys, y_true, y_pred (noise is -1). The contingency table
has a row per pair of labels that occurs, combined map-side; everything after
it is small, whatever the number of points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOISE = -1


def contingency(labels: DataFrame, keys: Sequence[str] = (), ignore_noise: bool = False) -> DataFrame:
    """(keys, y_true, y_pred, n)."""
    own = labels.filter((F.col("y_pred") != NOISE) & (F.col("y_true") != NOISE)) if ignore_noise else labels
    return own.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def _margins(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = lambda *by: F.sum("n").over(Window.partitionBy(*keys, *by))
    return table.withColumns({"a": sums("y_true"), "b": sums("y_pred"), "total": sums()})


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def agreement(labels: DataFrame, keys: Sequence[str] = (), ignore_noise: bool = False) -> DataFrame:
    """ARI, homogeneity, completeness, V-measure, NMI, Fowlkes-Mallows and purity (EXT-01 to EXT-03, EXT-07)."""
    m = _margins(contingency(labels, keys, ignore_noise), keys)
    n, a, b, total = (F.col(c).cast("double") for c in ("n", "a", "b", "total"))
    # A cell contributes its share of a margin, so sums over cells are sums over margins.
    h = lambda margin: -F.sum(n / total * F.ln(margin / total))
    best = m.withColumn("_top", F.max("n").over(Window.partitionBy(*keys, "y_pred")))
    cells = best.groupBy(*keys).agg(
        F.max("total").alias("n"),
        F.sum(_pairs(F.col("n"))).alias("s"),
        F.sum(n * (a - 1) / 2).alias("sa"),
        F.sum(n * (b - 1) / 2).alias("sb"),
        h(a).alias("ht"),
        h(b).alias("hp"),
        F.sum(n / total * F.ln(n * total / (a * b))).alias("mi"),
        (F.sum(n * F.col("_top") / b) / F.max(total)).alias("purity"),
    )
    pairs = _pairs(F.col("n"))
    expected = F.when(pairs > 0, F.col("sa") * F.col("sb") / pairs).otherwise(0.0)
    most = (F.col("sa") + F.col("sb")) / 2
    homogeneity = F.when(F.col("ht") > 0, F.col("mi") / F.col("ht")).otherwise(1.0)
    completeness = F.when(F.col("hp") > 0, F.col("mi") / F.col("hp")).otherwise(1.0)
    measured = cells.withColumns({"ari": F.when(most - expected == 0, 1.0).otherwise((F.col("s") - expected) / (most - expected)), "homogeneity": homogeneity, "completeness": completeness})
    both = F.col("homogeneity") + F.col("completeness")
    mean = (F.col("ht") + F.col("hp")) / 2
    return measured.select(
        *keys,
        "n",
        "ari",
        F.when(mean > 0, F.col("mi") / mean).otherwise(1.0).alias("nmi"),
        "homogeneity",
        "completeness",
        F.when(both > 0, 2 * F.col("homogeneity") * F.col("completeness") / both).otherwise(0.0).alias("v_measure"),
        F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("s") / F.sqrt(F.col("sa") * F.col("sb"))).otherwise(0.0).alias("fowlkes_mallows"),
        "purity",
    )


def expected_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Under the hypergeometric model of random labels with these margins."""
    n = int(a.sum())
    lg = np.vectorize(math.lgamma)
    total = 0.0
    for ai in a.tolist():
        for bj in b.tolist():
            k = np.arange(max(1, ai + bj - n), min(ai, bj) + 1)
            if len(k):
                log_p = lg(ai + 1) + lg(bj + 1) + lg(n - ai + 1) + lg(n - bj + 1) - lg(n + 1) - lg(k + 1) - lg(ai - k + 1) - lg(bj - k + 1) - lg(n - ai - bj + k + 1)
                total += float((k / n * np.log(n * k / (ai * bj)) * np.exp(log_p)).sum())
    return total


def adjusted_mutual_information(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ami) with the arithmetic mean of the entropies (EXT-02). One contingency table a task."""
    names = list(keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="y_true", columns="y_pred", values="n", fill_value=0).to_numpy().astype(int)
        n, a, b = table.sum(), table.sum(1), table.sum(0)
        i, j = np.nonzero(table)
        mi = float((table[i, j] / n * np.log(n * table[i, j] / (a[i] * b[j]))).sum())
        h = [float(-(x / n * np.log(x / n)).sum()) for x in (a, b)]
        emi = expected_mutual_information(a, b)
        low = sum(h) / 2 - emi
        ami = 1.0 if len(a) == len(b) == 1 or abs(low) < 1e-15 else (mi - emi) / low
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in names}, "ami": [ami]})

    table = contingency(labels, keys)
    ddl = ", ".join([*(f"{k} {table.schema[k].dataType.simpleString()}" for k in keys), "ami double"])
    return table.groupBy(*(names or [F.lit(1).alias("_one")])).applyInPandas(run, ddl)


def noise_scores(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Noise ratio, precision, recall and F1 of noise; NULL where the truth has none (EXT-04)."""
    t, p = F.col("y_true") == NOISE, F.col("y_pred") == NOISE
    hit, true, said = F.count_if(t & p), F.count_if(t), F.count_if(p)
    precision = F.when(true > 0, F.when(said > 0, hit / said).otherwise(0.0))
    recall = F.when(true > 0, hit / true)
    return labels.groupBy(*keys).agg(F.avg(p.cast("double")).alias("noise_ratio"), precision.alias("noise_precision"), recall.alias("noise_recall"), F.when(true > 0, 2 * hit / (said + true)).alias("noise_f1"))


def k_metrics(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Selected K without noise against the true K (EXT-05, EXT-06)."""
    k = F.countDistinct(F.when(F.col("y_pred") != NOISE, F.col("y_pred")))
    t = F.countDistinct(F.when(F.col("y_true") != NOISE, F.col("y_true")))
    return labels.groupBy(*keys).agg(k.alias("selected_k"), t.alias("true_k"), (k == t).alias("k_correct"), F.abs(k - t).alias("k_abs_error"), (k - t).alias("k_signed_error"))


def label_stats(labels: DataFrame, keys: Sequence[str], column: str = "y_pred") -> DataFrame:
    """Validity, clusters without noise, noise ratio, unique labels (SRC-26, FLT-03)."""
    k = F.countDistinct(F.when(F.col(column) != NOISE, F.col(column)))
    return labels.groupBy(*keys).agg((k >= 2).alias("valid"), k.alias("n_clusters"), F.avg((F.col(column) == NOISE).cast("double")).alias("noise_ratio"), F.countDistinct(column).alias("n_labels"))


def partition_hash(labels: DataFrame, keys: Sequence[str], point: str = "point_id", column: str = "y_pred") -> DataFrame:
    """(keys, partition_hash): equal for partitions that differ in cluster names only (EXT-09).

    Clusters are named by their first point; the hash adds up over points, so
    no task gathers a partition.
    """
    first = labels.groupBy(*keys, column).agg(F.min(point).alias("_name"))
    named = labels.join(first, [*keys, column])
    # Sums of 32-bit hashes stay exact in a long for two billion points.
    part = lambda seed: F.sum(F.xxhash64(point, "_name", F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return named.groupBy(*keys).agg(F.count("*").alias("n"), part(1).alias("h1"), part(2).alias("h2")).select(*keys, F.sha2(F.concat_ws(":", "n", "h1", "h2"), 256).alias("partition_hash"))
