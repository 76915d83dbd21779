"""Top-k choice of validity indices, weights, objectives and argmax rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nullsafe import clean_utility, finite

# The dynamic-K rule of the protocol.
ALPHA, SOFT_CAP, K_MIN, K_MAX = 0.92, 5, 1, 10
TIE = 1e-12


def top_k(utilities: DataFrame, k: int | Column, keys: Sequence[str], score: str = "utility", name: str = "metric_id") -> DataFrame:
    """The k best per group: score desc, non-finite last, name asc (WIN-01). Adds 'position' from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(finite(F.col(score))), name)
    return utilities.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def soft_cap(k: Column) -> Column:
    """k up to 5, then half the excess, rounded up, within 1 and 10 (WIN-03)."""
    return F.greatest(F.lit(K_MIN), F.least(F.lit(K_MAX), F.when(k <= SOFT_CAP, k).otherwise(F.ceil((k + SOFT_CAP) / 2)))).cast("int")


def dynamic_k(utilities: DataFrame, keys: Sequence[str], score: str = "utility") -> DataFrame:
    """(keys, k_rel, k): values within 0.92 of the best, soft-capped (WIN-02 to WIN-05)."""
    u = clean_utility(F.col(score))
    whole = Window.partitionBy(*keys)
    near = utilities.withColumn("_u", u).withColumn("_near", F.col("_u") >= ALPHA * F.max("_u").over(whole))
    return near.groupBy(*keys).agg(F.count_if("_near").alias("k_rel")).withColumn("k", soft_cap(F.col("k_rel")))


def select_dynamic(utilities: DataFrame, keys: Sequence[str], size_by: str = "utility", rank_by: str = "utility") -> DataFrame:
    """Top metrics by one score with the group's dynamic size from another (WIN-06)."""
    sized = utilities.join(dynamic_k(utilities, keys, size_by).select(*keys, "k"), list(keys))
    return top_k(sized, F.col("k"), keys, rank_by)


def softmax_weights(selected: DataFrame, keys: Sequence[str], score: str = "utility", temperature: float = 0.1) -> DataFrame:
    """Temperature softmax with the maximum shifted to 0 (FN-32)."""
    whole = Window.partitionBy(*keys)
    raised = F.exp((F.col(score) - F.max(score).over(whole)) / temperature)
    return selected.withColumn("_e", raised).withColumn("weight", F.col("_e") / F.sum("_e").over(whole)).drop("_e")


def positive_weights(selected: DataFrame, keys: Sequence[str], score: str = "utility") -> DataFrame:
    """Negative parts to 0, normalised; equal weights where nothing is left (FN-33)."""
    whole = Window.partitionBy(*keys)
    up = F.greatest(F.lit(0.0), F.coalesce(finite(F.col(score)), F.lit(0.0)))
    total = F.sum("_p").over(whole)
    return selected.withColumn("_p", up).withColumn("weight", F.when(total > 0, F.col("_p") / total).otherwise(1.0 / F.count("*").over(whole))).drop("_p")


def aggregate_online(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean of normalised values: a missing weight is 1, a missing value 0 (OBJ-05)."""
    w = F.coalesce("weight", F.lit(1.0))
    value = F.coalesce(finite(F.col("norm")), F.lit(0.0))
    return scored.groupBy(*keys).agg((F.sum(w * value) / F.sum(w)).alias("objective"))


def aggregate_offline(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted sum that is NULL if any value is not finite (OBJ-23)."""
    value = finite(F.col("norm"))
    whole = F.count("*") == F.count(value)
    return scored.groupBy(*keys).agg(F.when(whole, F.sum(F.col("weight") * value)).alias("objective"))


def offline_argmax(candidates: DataFrame, keys: Sequence[str], index: str = "candidate", tol: float = TIE) -> DataFrame:
    """First candidate within tol of the best objective, with regret against the best ARI (WIN-14)."""
    whole = Window.partitionBy(*keys)
    tied = candidates.withColumns({"_top": F.max("objective").over(whole), "_ceiling": F.max("ari").over(whole)}).filter(F.col("objective") >= F.col("_top") - tol)
    first = tied.groupBy(*keys).agg(F.min(index).alias(index), F.min_by("ari", index).alias("ari"), F.min_by("objective", index).alias("objective"), F.first("_ceiling").alias("ceiling"), F.count("*").alias("n_tied"))
    return first.withColumn("regret", F.col("ceiling") - F.col("ari"))


def select_reranked(candidates: DataFrame, keys: Sequence[str], predicted: str = "predicted_regret", index: str = "candidate", tol: float = TIE) -> DataFrame:
    """Lowest predicted regret of the eligible candidates, ties to the lowest index (WIN-15)."""
    low = F.min(predicted).over(Window.partitionBy(*keys))
    return candidates.filter("valid").withColumn("_low", low).filter(F.col(predicted) <= F.col("_low") + tol).groupBy(*keys).agg(F.min(index).alias(index))


def competition_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """1 is the largest; NULL keeps NULL (WIN-09)."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.rank().over(order)))


def average_rank(keys: Sequence[str], value: str, ascending: bool = True) -> Column:
    """Mean rank of equal values, from 1."""
    order = F.asc(value) if ascending else F.desc(value)
    same = F.count("*").over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (same - 1) / 2


def average_percentile(df: DataFrame, keys: Sequence[str], value: str, higher_is_better: bool = True) -> DataFrame:
    """Average rank over n; NULL gives 0.5 (WIN-12)."""
    full = df.withColumn("_has", F.col(value).isNotNull())
    rank = average_rank([*keys, "_has"], value, higher_is_better)
    n = F.count(value).over(Window.partitionBy(*keys))
    return full.withColumn("percentile", F.when(F.col("_has"), rank / n).otherwise(0.5)).drop("_has")


def tie_groups(df: DataFrame, keys: Sequence[str], value: str, index: str, tol: float = TIE) -> DataFrame:
    """Dense groups from 0 in descending order; a gap above tol starts a new one (WIN-11)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), index)
    gap = F.lag(value).over(order) - F.col(value)
    start = df.filter(F.col(value).isNotNull()).withColumn("_new", F.coalesce((gap > tol).cast("int"), F.lit(0)))
    grouped = start.withColumn("tie_group", F.sum("_new").over(order)).drop("_new")
    return grouped.withColumns({"group_size": F.count("*").over(Window.partitionBy(*keys, "tie_group")), "is_best": F.col("tie_group") == 0})


def trace_gap(trials: DataFrame, keys: Sequence[str], index: str = "candidate") -> DataFrame:
    """Chosen trial (best objective) against the best ARI of the trace, with ranks of both (WIN-16, PF-18)."""
    whole = Window.partitionBy(*keys)
    ranked = trials.filter("ari is not null").withColumns({"rank_ari": F.rank().over(whole.orderBy(F.desc("ari"))), "rank_objective": F.rank().over(whole.orderBy(F.desc_nulls_last("objective")))})
    chosen = F.max(F.struct("objective", (-F.col(index)).alias("at"), "ari", "rank_ari"))
    best = F.max(F.struct("ari", (-F.col(index)).alias("at"), "rank_objective"))
    found = ranked.groupBy(*keys).agg(chosen.alias("c"), best.alias("b"))
    return found.select(
        *keys,
        F.col("c.ari").alias("selected_ari"),
        F.col("b.ari").alias("best_ari"),
        (F.col("b.ari") - F.col("c.ari")).alias("gap"),
        F.when(F.abs("b.ari") > TIE, (F.col("b.ari") - F.col("c.ari")) / F.col("b.ari")).alias("relative_gap"),
        F.col("c.rank_ari").alias("rank_of_selected"),
        F.col("b.rank_objective").alias("rank_of_best"),
    )


def curve(utilities: DataFrame, keys: Sequence[str], score: str = "utility") -> DataFrame:
    """Sorted values with gaps, cumulative mass, entropy and participation ratio (WIN-22)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "metric_id")
    whole = Window.partitionBy(*keys)
    total = F.sum(score).over(whole)
    p = F.when(total > 0, F.col(score) / total)
    return utilities.withColumn("_p", p).select(
        *keys,
        "metric_id",
        F.row_number().over(order).alias("position"),
        F.col(score).alias("value"),
        (F.col(score) - F.lead(score).over(order)).alias("gap"),
        F.sum("_p").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("mass"),
        F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.ln("_p"))).over(whole).alias("entropy"),
        (1.0 / F.sum(F.col("_p") * F.col("_p")).over(whole)).alias("participation"),
    )


def k_rules(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes by relative threshold, cumulative mass, effective number and elbow (WIN-23)."""
    top = F.max("value")
    thresholds = [F.count_if(F.col("value") >= a * F.col("_top")).alias(f"rel_{round(100 * a)}") for a in (0.8, 0.85, 0.9, 0.92, 0.95, 0.98)]
    masses = [F.min(F.when(F.col("mass") >= m - TIE, F.col("position"))).alias(f"mass_{round(100 * m)}") for m in (0.5, 0.7, 0.8, 0.9, 0.95)]
    with_top = curves.withColumn("_top", top.over(Window.partitionBy(*keys)))
    return with_top.groupBy(*keys).agg(
        *thresholds,
        *masses,
        F.ceil(F.exp(F.first("entropy"))).alias("perplexity"),
        F.ceil(F.first("participation")).alias("participation"),
        F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("position")).alias("at")))).getField("at").alias("_elbow"),
    ).withColumn("elbow", -F.col("_elbow")).drop("_elbow")
