"""Which validity index is useful where: utilities of all indices over datasets, groups and views.

Long utilities: dataset_id, metric_id, utility, and group columns. Every table
is one or two aggregations over the metrics of a dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import aggregate_offline, average_rank, offline_argmax, positive_weights, select_dynamic, softmax_weights, top_k
from .summaries import q


def ranked(utilities: DataFrame, unit: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """utilities with rank (average of ties, 1 is best) and position (ties by name) within a unit."""
    order = Window.partitionBy(*unit).orderBy(F.desc("utility"), "metric_id")
    return utilities.withColumns({"rank": average_rank(unit, "utility", ascending=False), "position": F.row_number().over(order)})


def global_utility(utilities: DataFrame, k: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Per index: mean, median, spread, mean rank, shares of first place and of the top k (AGG-44, AGG-46)."""
    return ranked(utilities).groupBy(*keys, "metric_id").agg(
        F.count("*").alias("n"),
        F.avg("utility").alias("utility_mean"),
        q("utility", 0.5).alias("utility_median"),
        F.stddev_samp("utility").alias("utility_std"),
        F.avg("rank").alias("rank_mean"),
        F.avg((F.col("position") == 1).cast("double")).alias("first_share"),
        F.avg((F.col("position") <= k).cast("double")).alias("top_share"),
    )


def group_contrast(utilities: DataFrame, catalog: DataFrame, group: str) -> DataFrame:
    """Per dataset: mean utility of an index group's members against the others', summarised (AGG-45)."""
    placed = utilities.join(F.broadcast(catalog), "metric_id")
    inside = F.avg(F.when(F.col(group) == F.col("_g"), F.col("utility")))
    outside = F.avg(F.when(F.col(group) != F.col("_g"), F.col("utility")))
    groups = catalog.select(F.col(group).alias("_g")).distinct()
    per = placed.join(F.broadcast(groups)).groupBy("dataset_id", "_g").agg(inside.alias("inside"), outside.alias("outside"))
    d = F.col("inside") - F.col("outside")
    return per.filter("inside is not null and outside is not null").groupBy(F.col("_g").alias(group)).agg(F.count("*").alias("n"), F.avg("inside").alias("inside_mean"), F.avg(d).alias("contrast_mean"), q(d, 0.5).alias("contrast_median"), F.avg((d > 0).cast("double")).alias("positive_share"))


def uplift(utilities: DataFrame, level: str) -> DataFrame:
    """Mean utility of an index inside a group minus that outside: totals minus group, no join back (GEN-15)."""
    own = utilities.groupBy(level, "metric_id").agg(F.sum("utility").alias("s"), F.count("utility").alias("n"))
    whole = Window.partitionBy("metric_id")
    total = own.withColumns({"_s": F.sum("s").over(whole), "_n": F.sum("n").over(whole)})
    rest = F.when(F.col("_n") > F.col("n"), (F.col("_s") - F.col("s")) / (F.col("_n") - F.col("n")))
    return total.select(level, "metric_id", "n", (F.col("s") / F.col("n")).alias("inside"), rest.alias("outside"), (F.col("s") / F.col("n") - rest).alias("uplift"))


def core_breadth(utilities: DataFrame, level: str, k: int = 2) -> DataFrame:
    """In how many groups an index is among the top k by mean utility, and the evenness of its mass over groups (GEN-16)."""
    mean = utilities.groupBy(level, "metric_id").agg(F.avg("utility").alias("utility"))
    placed = ranked(mean, [level])
    p = F.col("utility") / F.sum("utility").over(Window.partitionBy("metric_id"))
    return placed.withColumn("_p", p).groupBy("metric_id").agg(
        F.count("*").alias("n_groups"),
        F.count_if(F.col("position") <= k).alias("n_top"),
        F.when(F.count("*") > 1, -F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p")).otherwise(0.0)) / F.ln(F.count("*"))).otherwise(0.0).alias("evenness"),
    )


def specialists(table: DataFrame, core: DataFrame, least: float = 0.0, most_groups: int = 3) -> DataFrame:
    """Uplifts above `least` of indices that are on top in few groups (GEN-17)."""
    narrow = core.filter(F.col("n_top") <= most_groups).select("metric_id")
    return table.filter(F.col("uplift") > least).join(F.broadcast(narrow), "metric_id", "left_semi")


def complementarity(utilities: DataFrame, new: Sequence[str]) -> DataFrame:
    """Per new index: gain over the best other index, share of datasets it wins, and the ceiling with it (GEN-14)."""
    best = F.max(F.when(~F.col("metric_id").isin(*new), F.col("utility"))).over(Window.partitionBy("dataset_id"))
    with_best = utilities.withColumn("_best", best).filter(F.col("metric_id").isin(*new))
    gain = F.col("utility") - F.col("_best")
    return with_best.groupBy("metric_id").agg(F.count("*").alias("n"), F.avg(gain).alias("gain_mean"), F.avg((gain > 0).cast("double")).alias("win_share"), F.avg(F.greatest("utility", "_best")).alias("ceiling_mean"))


def alignment(truth: DataFrame, predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of true and predicted utilities per dataset, averaged (GEN-18)."""
    both = truth.join(predicted.select("dataset_id", "metric_id", F.col("utility").alias("predicted")), ["dataset_id", "metric_id"])
    r = both.withColumns({"_x": average_rank(["dataset_id"], "utility"), "_y": average_rank(["dataset_id"], "predicted")})
    per = r.groupBy("dataset_id", *keys).agg(F.when((F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0), F.corr("_x", "_y")).alias("rho"))
    return per.groupBy(*keys).agg(F.count("rho").alias("n"), F.avg("rho").alias("rho_mean"), q("rho", 0.5).alias("rho_median"))


def top_k_recall(truth: DataFrame, predicted: DataFrame, k: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Share of the true top k that the prediction has (GEN-19)."""
    a = ranked(truth).select("dataset_id", *keys, "metric_id", F.col("position").alias("_a"))
    b = ranked(predicted).select("dataset_id", "metric_id", F.col("position").alias("_b"))
    hit = F.count_if((F.col("_a") <= k) & (F.col("_b") <= k))
    return a.join(b, ["dataset_id", "metric_id"]).groupBy(*keys).agg(F.countDistinct("dataset_id").alias("n_datasets"), (hit / F.count_if(F.col("_a") <= k)).alias("recall"))


def replay(utilities: DataFrame, candidates: DataFrame, sizes: Sequence[str] = ("1", "3", "dynamic"), temperature: float = 0.1) -> DataFrame:
    """Each policy's choice among fixed candidates: (source, size, weighting, dataset_id, candidate, ari, regret) (OBJ-25 to OBJ-27).

    utilities: source, dataset_id, metric_id, utility. candidates: dataset_id,
    candidate, ari, metric_id, norm. A policy takes the top indices of its
    source, weighs them and takes the first candidate of the best objective.
    """
    unit = ["source", "dataset_id"]
    chosen = None
    for size in sizes:
        own = select_dynamic(utilities, unit) if size == "dynamic" else top_k(utilities, int(size), unit)
        own = own.select(*unit, "metric_id", "utility").withColumn("size", F.lit(size))
        chosen = own if chosen is None else chosen.unionByName(own)
    by = [*unit, "size"]
    weights = positive_weights(chosen, by).withColumn("weighting", F.lit("raw")).unionByName(softmax_weights(chosen, by, temperature=temperature).withColumn("weighting", F.lit("softmax")))
    scored = weights.drop("utility").join(candidates, ["dataset_id", "metric_id"])
    policy = ["source", "size", "weighting", "dataset_id"]
    j = aggregate_offline(scored, [*policy, "candidate", "ari"]).withColumn("objective", F.round("objective", 9))
    return offline_argmax(j, policy).select(*policy, "candidate", "ari", "regret")
