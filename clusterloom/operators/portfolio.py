"""Portfolios of methods: virtual best, coverage, greedy growth, representatives and their stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import resampling
from .summaries import q

TIE = 1e-12
#: Greedy construction runs a small aggregation a step; portfolios are declared lists of methods.
MAX_MEMBERS = 64


def virtual_best(best: DataFrame, members: Sequence[str] | None = None, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Winner per dataset by ARI, view median and view mean desc, runtime and name asc, with the reason (WIN-19, PF-08)."""
    own = best.filter(F.col("method_name").isin(*members)) if members else best
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(F.desc_nulls_last("best_ari"), F.desc_nulls_last("view_median"), F.desc_nulls_last("view_mean"), F.asc_nulls_last("best_runtime_sec"), "method_name")
    topped = own.withColumn("_top", F.max("best_ari").over(whole))
    marked = topped.withColumns(
        {
            "_n": F.row_number().over(order),
            "n_members": F.count("*").over(whole),
            "portfolio_runtime_sec": F.sum("total_runtime_sec").over(whole),
            "n_tied": F.sum((F.col("best_ari") >= F.col("_top") - TIE).cast("int")).over(whole),
        }
    )
    reason = F.when(F.col("best_ari").isNull(), "none").when(F.col("n_tied") > 1, "tie_break").otherwise("ari")
    return marked.filter("_n = 1").select(*keys, F.col("method_name").alias("winner"), F.col("best_ari").alias("vbs_ari"), "n_members", "portfolio_runtime_sec", F.coalesce("n_tied", F.lit(0)).alias("n_tied"), reason.alias("reason"))


def vbs_summary(vbs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median and quartiles of the virtual best (PF-09)."""
    return vbs.groupBy(*keys).agg(F.count("*").alias("n_datasets"), F.avg("vbs_ari").alias("vbs_mean"), q("vbs_ari", 0.5).alias("vbs_median"), F.sum("portfolio_runtime_sec").alias("runtime_sec"), F.avg((F.col("reason") == "tie_break").cast("double")).alias("tie_rate"))


def winner_composition(vbs: DataFrame) -> DataFrame:
    """Wins and shares by method (PF-10)."""
    total = F.sum(F.count("*")).over(Window.partitionBy())
    return vbs.filter("vbs_ari is not null").groupBy("winner").agg(F.count("*").alias("wins"), (F.count("*") / total).alias("share"))


def unique_coverage(best: DataFrame) -> DataFrame:
    """How often a method alone reaches a dataset's maximum (WIN-20)."""
    whole = Window.partitionBy("dataset_id")
    at_top = best.filter("best_ari is not null").withColumn("_at", F.col("best_ari") >= F.max("best_ari").over(whole) - TIE)
    marked = at_top.withColumn("_alone", F.col("_at") & (F.sum(F.col("_at").cast("int")).over(whole) == 1))
    return marked.groupBy("method_name").agg(F.count_if("_at").alias("n_best"), F.count_if("_alone").alias("n_unique"), F.count("*").alias("n_datasets"))


def headroom(best: DataFrame) -> DataFrame:
    """Virtual best of all minus each method, paired by dataset (PF-11)."""
    gap = F.max("best_ari").over(Window.partitionBy("dataset_id")) - F.col("best_ari")
    return best.withColumn("_gap", gap).filter("_gap is not null").groupBy("method_name").agg(F.count("*").alias("n"), F.avg("_gap").alias("headroom_mean"), q("_gap", 0.5).alias("headroom_median"), F.max("_gap").alias("headroom_max"))


def greedy_portfolio(best: DataFrame, max_size: int | None = None) -> DataFrame:
    """(step, method_name, gain, portfolio_mean): each step adds the method with the largest gain, ties by name (PF-12).

    The mean counts a dataset without any result as 0. The scores are held as
    one map a dataset; a step is one aggregation with a row a method.
    """
    spark = best.sparkSession
    held = best.groupBy("dataset_id").agg(F.map_from_entries(F.collect_list(F.struct("method_name", F.coalesce("best_ari", F.lit(0.0)).alias("v")))).alias("of")).cache()
    names = [r.method_name for r in best.select("method_name").distinct().orderBy("method_name").limit(MAX_MEMBERS + 1).collect()]
    if len(names) > MAX_MEMBERS:
        raise ValueError(f"a portfolio has {MAX_MEMBERS} methods at most")
    chosen: list[str] = []
    rows, mean = [], 0.0
    for step in range(1, min(max_size or len(names), len(names)) + 1):
        now = F.greatest(F.lit(0.0), *(F.coalesce(F.element_at("of", m), F.lit(0.0)) for m in [*chosen, *chosen[:1]])) if chosen else F.lit(0.0)
        left = [m for m in names if m not in chosen]
        got = held.agg(*(F.round(F.avg(F.greatest(now, F.coalesce(F.element_at("of", m), F.lit(0.0)))), 12).alias(f"m{i}") for i, m in enumerate(left))).first()
        if got is None or got[0] is None:
            break
        at = max(range(len(left)), key=lambda i: (got[i], -i))
        rows.append((step, left[at], float(got[at]) - mean, float(got[at])))
        mean = float(got[at])
        chosen.append(left[at])
    held.unpersist()
    return spark.createDataFrame(rows, "step int, method_name string, gain double, portfolio_mean double")


def min_size_for_gain(greedy: DataFrame, share: float = 0.95) -> DataFrame:
    """Smallest size that reaches a share of the full gain (PF-15)."""
    full = F.max("portfolio_mean").over(Window.partitionBy())
    return greedy.withColumn("_full", full).filter(F.col("portfolio_mean") >= share * F.col("_full") - TIE).agg(F.min("step").alias("min_size"))


def representative(best: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chosen method of a pool with its runner-up and practical equivalents (PF-01, PF-02, WIN-18).

    Order: mean and median ARI in steps of 1e-6, then spread, runtime, name.
    """
    summary = best.groupBy(*keys, "method_name").agg(F.avg("best_ari").alias("mean"), q("best_ari", 0.5).alias("median"), F.stddev_samp("best_ari").alias("std"), F.avg("total_runtime_sec").alias("runtime"))
    step = lambda c: F.bround(F.col(c) / 1e-6, 0)
    order = Window.partitionBy(*keys).orderBy(step("mean").desc_nulls_last(), step("median").desc_nulls_last(), F.asc_nulls_last("std"), F.asc_nulls_last("runtime"), "method_name")
    ranked = summary.withColumns({"place": F.row_number().over(order), "_top": F.max("mean").over(Window.partitionBy(*keys))})
    close = F.count_if((F.col("place") > 1) & (F.col("_top") - F.col("mean") <= 0.001))
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("place") == 1, F.col("method_name"))).alias("selected"), F.max(F.when(F.col("place") == 2, F.col("method_name"))).alias("runner_up"), F.max(F.when(F.col("place") == 1, F.col("mean"))).alias("selected_mean"), close.alias("n_equivalent"))


def selection_stability(best: DataFrame, draws: int = 1000, seed: int = 1234, keys: Sequence[str] = ()) -> DataFrame:
    """How often each method wins the pool, or each group's, when datasets are resampled (PF-06, PF-07, ST-12)."""
    return resampling.winners(best, keys, "method_name", "best_ari", "dataset_id", draws, seed)


def random_subset_curve(best: DataFrame, draws: int = 200, seed: int = 1234) -> DataFrame:
    """(size, mean, low, high) of the virtual best of random subsets (PF-14).

    Each draw orders the methods by a hash; the prefix of length s is its
    subset of size s, so a running maximum gives all sizes of a draw at once.
    """
    scored = best.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_o", F.xxhash64("method_name", "draw", F.lit(seed)))
    order = Window.partitionBy("dataset_id", "draw").orderBy("_o", "method_name")
    grown = scored.withColumns({"size": F.row_number().over(order), "top": F.max(F.coalesce("best_ari", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    per_draw = grown.groupBy("draw", "size").agg(F.avg("top").alias("m"))
    return per_draw.groupBy("size").agg(F.avg("m").alias("mean"), q("m", 0.025).alias("low"), q("m", 0.975).alias("high"))
