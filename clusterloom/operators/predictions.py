"""Scores of predicted utility vectors, weight resolution from utility profiles, and the neighbour-configuration search.

Vectors are long: a row a metric with the true and the predicted utility.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nullsafe import strip_prefix
from . import neighbours, ranking
from .ranking import average_percentile, dynamic_k
from .summaries import q
from .utility import candidate_pairs, ndcg, positions, regression_errors

EPS = 1e-12
# The grid of the neighbour search.
NEIGHBOURS = (1, 2, 3, 5, 7, 10, 15, 20, 30, 50, 75, 100)
SCALERS, DISTANCES, WEIGHTINGS = ("standard", "robust"), ("euclidean", "cosine"), ("uniform", "inverse_distance")


def placed(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """vectors with 'at_true' and 'at_predicted', positions from 1, ties by name."""
    return positions(positions(vectors, keys, "truth", "metric_id", "at_true"), keys, "predicted", "metric_id", "at_predicted")


def top1_scores(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per vector: whether the predicted best is best, its true rank from 0, what its utility lacks, and its own error (FN-36)."""
    per = placed(vectors, keys).groupBy(*keys).agg(F.max("truth").alias("best"), F.min_by(F.struct("truth", "predicted", "at_true"), "at_predicted").alias("p"))
    return per.select(*keys, (F.col("p.at_true") == 1).alias("hit"), (F.col("p.at_true") - 1).alias("rank_distance"), F.abs(F.col("best") - F.col("p.truth")).alias("utility_error"), F.abs(F.col("p.predicted") - F.col("p.truth")).alias("calibration_error"))


def top_k_scores(vectors: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Per vector: overlap, ordered accuracy, precision, recall and Jaccard of the top k, and errors over their union (FN-37)."""
    a, b, e = F.col("at_true") <= k, F.col("at_predicted") <= k, F.col("predicted") - F.col("truth")
    size = F.least(F.lit(k), F.count("*"))
    shared = F.count_if(a & b)
    return placed(vectors, keys).groupBy(*keys).agg(
        (shared / size).alias("overlap"), (F.count_if(a & (F.col("at_true") == F.col("at_predicted"))) / size).alias("ordered"), (shared / F.count_if(a | b)).alias("jaccard"),
        F.sum(F.when(a | b, F.abs(e))).alias("abs_error"), F.sum(F.when(a | b, e * e)).alias("squared_error"), F.count_if(a | b).alias("n_union"),
    )


def rank_scores(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per vector: Spearman of positions, pairwise accuracy and tau over untied pairs, and rank displacement (FN-38)."""
    away = F.abs(F.col("at_true") - F.col("at_predicted"))
    moved = placed(vectors, keys).groupBy(*keys).agg(F.coalesce(F.corr("at_true", "at_predicted"), F.lit(0.0)).alias("spearman"), F.avg(away).alias("displacement_mean"), q(away, 0.5).alias("displacement_median"), F.max(away).alias("displacement_max"))
    s = F.col("dx") * F.col("dy")
    pairs = candidate_pairs(vectors, keys, "truth", "predicted", "metric_id").filter(s != 0).groupBy(*keys).agg(F.avg((s > 0).cast("double")).alias("pairwise"))
    return moved.join(pairs, list(keys), "left").withColumn("kendall", 2 * F.col("pairwise") - 1)


def score_suite(vectors: DataFrame, keys: Sequence[str], tops: Sequence[int] = (3, 5, 10), gains: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """(score, value), long: the full suite over all vectors (FN-40)."""
    mean = lambda df, columns, name: df.select(F.explode(F.array(*(F.struct(F.lit(name(c)).alias("score"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).groupBy("x.score").agg(F.avg("x.v").alias("value"))
    errors = regression_errors(vectors.withColumn("_all", F.lit(1)), ["_all"])
    parts = [
        mean(errors, ["mse", "rmse", "mae", "r2"], str),
        mean(top1_scores(vectors, keys), ["hit", "rank_distance", "utility_error", "calibration_error"], "top1_{}".format),
        mean(rank_scores(vectors, keys), ["spearman", "kendall", "pairwise", "displacement_mean", "displacement_median", "displacement_max"], str),
    ]
    for k in tops:
        top = top_k_scores(vectors, keys, k)
        parts.append(mean(top, ["overlap", "ordered", "jaccard"], f"top{k}_{{}}".format))
        parts.append(top.agg(F.lit(f"top{k}_utility_mae").alias("score"), (F.sum("abs_error") / F.sum("n_union")).alias("value")))
        parts.append(top.agg(F.lit(f"top{k}_utility_rmse").alias("score"), F.sqrt(F.sum("squared_error") / F.sum("n_union")).alias("value")))
    for k in (*gains, None):
        name = f"ndcg@{k or 'all'}"
        parts.append(mean(ndcg(vectors, keys, "predicted", "truth", "metric_id", k, exponential=False), ["ndcg"], lambda _, n=name: n))
    return reduce(DataFrame.union, parts)


def both_sizes(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, k_true, k_predicted): the dynamic K of both vectors."""
    size = lambda score, name: dynamic_k(vectors, keys, score).select(*keys, F.col("k").alias(name))
    return size("truth", "k_true").join(size("predicted", "k_predicted"), list(keys))


def dynamic_k_scores(sizes: DataFrame) -> DataFrame:
    """One row: how well the predicted K meets the true one (FN-41)."""
    off = F.col("k_predicted") - F.col("k_true")
    share = lambda c: F.avg(c.cast("double"))
    return sizes.agg(
        F.count("*").alias("n"), share(off == 0).alias("exact"), share(F.abs(off) <= 1).alias("within_1"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("bias"),
        share(off < 0).alias("under"), share(off > 0).alias("over"), F.avg("k_true").alias("k_true_mean"), F.avg("k_predicted").alias("k_predicted_mean"),
    )


def dynamic_k_confusion(sizes: DataFrame, k_min: int = 1, k_max: int = 10) -> DataFrame:
    """(k_true, k_predicted, n) of every cell of the square, zeros too (FN-42)."""
    k = sizes.sparkSession.range(k_min, k_max + 1)
    cells = k.select(F.col("id").cast("int").alias("k_true"), F.explode(F.sequence(F.lit(k_min), F.lit(k_max))).alias("k_predicted"))
    counts = sizes.groupBy("k_true", "k_predicted").agg(F.count("*").alias("n"))
    return cells.join(counts, ["k_true", "k_predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def weights(selected: DataFrame, keys: Sequence[str], scheme: str = "softmax", temperature: float = 0.5) -> DataFrame:
    """Weights by the named scheme (FN-34): softmax, or normalized_positive."""
    if scheme == "softmax":
        return ranking.softmax_weights(selected, keys, temperature=temperature)
    if scheme == "normalized_positive":
        return ranking.positive_weights(selected, keys)
    raise ValueError(f"unknown weighting: {scheme!r}")


def resolve_weights(profile: DataFrame, keys: Sequence[str], top_k: int | str = 5, scheme: str = "softmax", temperature: float = 0.5, size_from: DataFrame | None = None, pool: Sequence[str] | None = None) -> DataFrame:
    """(keys, metric_id, weight, position) from a utility profile (OBJ-06 to OBJ-08, OBJ-10 to OBJ-12).

    The profile may come from the network, the neighbours or the true vectors:
    keys, metric_id (a 'utility__' prefix is dropped) and utility. top_k is a
    number or 'dynamic'; size_from then gives the vector that sizes K, else the
    profile itself. pool restricts the metrics.
    """
    own = lambda df: df.withColumn("metric_id", F.coalesce(strip_prefix(F.col("metric_id")), F.col("metric_id")))
    ranked = own(profile)
    ranked = ranked.filter(F.col("metric_id").isin(*pool)) if pool else ranked
    if top_k == "dynamic":
        sizes = dynamic_k(own(size_from) if size_from is not None else ranked, keys).select(*keys, "k")
        chosen = ranking.top_k(ranked.join(sizes, list(keys)), F.col("k"), keys).drop("k")
    else:
        chosen = ranking.top_k(ranked, int(top_k), keys)
    return weights(chosen, keys, scheme, temperature).select(*keys, "metric_id", "weight", "position")


def with_fallback(resolved: DataFrame, units: DataFrame, keys: Sequence[str], fallback: Mapping[str, float]) -> DataFrame:
    """Resolved weights, and the fallback metrics for units without any (OBJ-09), marked as such."""
    entries = F.explode(F.array(*(F.struct(F.lit(m).alias("metric_id"), F.lit(float(w)).alias("weight")) for m, w in fallback.items()))).alias("x")
    none = units.select(*keys).distinct().join(resolved.select(*keys).distinct(), list(keys), "left_anti")
    used = none.select(*keys, entries).select(*keys, "x.metric_id", "x.weight", F.lit(True).alias("used_fallback"))
    return resolved.select(*keys, "metric_id", "weight", F.lit(False).alias("used_fallback")).union(used)


def neighbour_grid() -> list[dict]:
    """The 96 configurations of the neighbour search (ML-06)."""
    names = ("n_neighbors", "scaler", "distance", "weighting")
    return [dict(zip(names, c, strict=True)) | {"config_id": "n{:03d}__{}__{}__{}".format(*c)} for c in itertools.product(NEIGHBOURS, SCALERS, DISTANCES, WEIGHTINGS)]


def grid_predictions(found: DataFrame, utilities: DataFrame, sizes: Sequence[int] = NEIGHBOURS) -> DataFrame:
    """(n_neighbors, weighting, query_id, metric_id, utility) of all sizes and weightings from one neighbour list (ML-07).

    found: query_id, neighbour_id, distance, position of the largest size. A
    size is a running sum over positions, so utilities are joined once.
    """
    exact = F.max((F.col("distance") <= neighbours.EXACT).cast("int")).over(Window.partitionBy("query_id"))
    marked = found.withColumn("_exact", exact).withColumn("_match", F.col("distance") <= neighbours.EXACT)
    alone = (F.col("_exact") == 1) & ~F.col("_match")
    met = marked.join(utilities.withColumnRenamed("dataset_id", "neighbour_id"), "neighbour_id")
    weighted = {"uniform": F.lit(1.0), "inverse_distance": F.when(alone, 0.0).when(F.col("_match"), 1.0).otherwise(1 / (F.col("distance") + EPS))}
    up = Window.partitionBy("query_id", "metric_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("position").over(Window.partitionBy("query_id", "metric_id"))
    run = met.withColumns({"_last": last} | {k: F.sum(w * F.col("utility")).over(up) / F.sum(w).over(up) for k, w in weighted.items()})
    # A query with fewer neighbours than a size uses all it has.
    asked = F.filter(F.array(*map(F.lit, sizes)), lambda n: (n == F.col("position")) | ((n > F.col("position")) & (F.col("position") == F.col("_last"))))
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("weighting"), F.col(k).alias("utility")) for k in weighted))).alias("x")
    long = run.select("query_id", "metric_id", F.explode(asked).alias("n_neighbors"), *weighted).select("query_id", "metric_id", "n_neighbors", stacked)
    return long.select("n_neighbors", "x.weighting", "query_id", "metric_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x.utility"))).alias("utility"))


def out_of_fold(folds: DataFrame, features: DataFrame, utilities: DataFrame, k: int, metric: str = "euclidean", weighting: str = "inverse") -> DataFrame:
    """Predictions of each dataset by the neighbours outside its fold (ML-12). folds: dataset_id, fold (one a dataset)."""
    placed = features.join(folds, "dataset_id")
    out = None
    for (fold,) in folds.select("fold").distinct().orderBy("fold").collect():  # as many as declared splits
        own, rest = placed.filter(F.col("fold") == fold), placed.filter(F.col("fold") != fold)
        found = neighbours.knn_join(own, rest, k, "dataset_id", "features", metric)
        part = neighbours.predict_utilities(found, utilities, weighting).withColumn("fold", F.lit(fold))
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("query_id", "dataset_id")


def fold_composite(scores: DataFrame, groups: Mapping[str, Mapping[str, bool]], config: str = "config_id") -> DataFrame:
    """(fold, config, score by group, composite): means of direction-aware percentiles within each fold, groups weighing alike (ML-10)."""
    names = [(m, up) for g in groups.values() for m, up in g.items()]
    ranked = reduce(lambda df, x: average_percentile(df, ["fold"], x[0], x[1]).withColumnRenamed("percentile", f"_p_{x[0]}"), names, scores)
    by = {f"score_{g}": sum((F.col(f"_p_{m}") for m in own), F.lit(0.0)) / len(own) for g, own in groups.items()}
    return ranked.select("fold", config, *(c.alias(n) for n, c in by.items())).withColumn("composite", sum((F.col(n) for n in by), F.lit(0.0)) / len(by))


def policy_rerankers(policies: Sequence[Mapping]) -> list[dict]:
    """Each policy with its reranker: source and K decide, the weighting does not (RNK-12)."""
    k = lambda p: "dynamic" if p["top_k"] == "dynamic" else f"top{int(p['top_k'])}"
    return [{"policy_id": p["policy_id"], "reranker_id": f"{p['source']}_{k(p)}".upper(), "weighting": p["weighting"]} for p in policies]


def policy_features(meta: Sequence[str], utility: Sequence[str], feature_set: str, unified: bool = True, view: str = "view_id") -> list[Column]:
    """Columns of the feature sets META, UTILITIES and META_UTILITIES, with a one-hot view for the unified model (RNK-15)."""
    sets = {"META": [*meta], "UTILITIES": [*utility], "META_UTILITIES": [*meta, *utility]}
    views = [(F.col(view) == v).cast("double").alias(f"view__{v}") for v in ("x_only", "y_only", "xy_2d")]
    return [*map(F.col, sets[feature_set]), *(views if unified else [])]


def selector_scores(selected: DataFrame, policies: DataFrame, tol: float = EPS) -> DataFrame:
    """One row: best-view ARI of a selector, the best single policy, the best policy by view, the oracle, and the share of the gap that
    it recovers (RNK-16).

    selected: dataset_id, view_id, ari. policies: dataset_id, view_id, policy_id, ari.
    """
    level = lambda df: df.groupBy("dataset_id").agg(F.max("ari").alias("a")).agg(F.avg("a")).first()[0]
    mean = policies.groupBy("dataset_id", "policy_id").agg(F.max("ari").alias("a")).groupBy("policy_id").agg(F.avg("a").alias("m"))
    single = mean.orderBy(F.desc("m"), "policy_id").limit(1)
    order = Window.partitionBy("view_id").orderBy(F.desc("m"), "policy_id")
    by_view = policies.groupBy("view_id", "policy_id").agg(F.avg("ari").alias("m")).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    own, one = level(selected), level(policies.join(single.select("policy_id"), "policy_id"))
    view, best = level(policies.join(by_view.select("view_id", "policy_id"), ["view_id", "policy_id"])), level(policies)
    part = lambda base: (own - base) / (best - base) if None not in (own, base, best) and best - base > tol else None
    return selected.sparkSession.createDataFrame([(own, one, view, best, part(one), part(view))], "selector double, best_single double, best_by_view double, oracle double, recovery_single double, recovery_view double")


def nearest_label(queries: DataFrame, references: DataFrame, labels: DataFrame, columns: Sequence[str], id_col: str = "record_id", label: str = "best_algorithm") -> DataFrame:
    """The label of the nearest reference on unscaled features, missing ones 0 (BL-02)."""
    vector = F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns))
    shaped = lambda df: df.select(id_col, vector.alias("features"))
    near = neighbours.knn_join(shaped(queries), shaped(references.join(labels.select(id_col), id_col, "left_semi")), 1, id_col, "features")
    return near.join(labels.select(F.col(id_col).alias("neighbour_id"), label), "neighbour_id").select(F.col("query_id").alias(id_col), "neighbour_id", "distance", label)
