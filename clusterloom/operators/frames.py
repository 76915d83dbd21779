"""Run frames (a row per dataset, method and view) and best-view frames (a row per dataset and method).

Columns of a run frame: dataset_id, method_name, view_id, view_rank, ari,
runtime_sec, status, selected_k, true_k, family; others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = ("dataset_id", "method_name")


def succeeded() -> Column:
    return (F.col("status") == "success") & F.col("ari").isNotNull()


def best_view_frame(runs: DataFrame) -> DataFrame:
    """Canonical best view (AGG-08, AGG-09): ARI desc, runtime asc, view order.

    One aggregation and no join back: the best row is the largest struct. A
    unit without any success keeps a row with NULL results.
    """
    carried = [c for c in runs.columns if c not in {*UNIT, "ari", "runtime_sec", "view_rank"}]
    key = F.struct("ari", F.coalesce(-F.col("runtime_sec"), F.lit(float("-inf"))).alias("cheap"), (-F.col("view_rank")).alias("order"), "runtime_sec", *carried)
    ok = F.when(succeeded(), F.col("ari"))
    return (
        runs.groupBy(*UNIT)
        .agg(
            F.max(F.when(succeeded(), key)).alias("best"),
            F.sum("runtime_sec").alias("total_runtime_sec"),
            F.count("*").alias("n_views"),
            F.count(ok).alias("n_success"),
            F.avg(ok).alias("view_mean"),
            F.percentile(ok, F.lit(0.5)).alias("view_median"),
            F.min(ok).alias("view_min"),
            *(F.min(c).alias(f"any_{c}") for c in ("family", "true_k") if c in carried),
        )
        .select(
            *UNIT,
            F.col("best.ari").alias("best_ari"),
            F.col("best.view_id").alias("best_view"),
            F.col("best.runtime_sec").alias("best_runtime_sec"),
            "total_runtime_sec",
            "n_views",
            "n_success",
            "view_mean",
            "view_median",
            "view_min",
            *(F.col(f"any_{c}").alias(c) for c in ("family", "true_k") if c in carried),
            *(F.col(f"best.{c}").alias(c) for c in carried if c not in {"view_id", "family", "true_k"}),
        )
    )


def best_view_rows(runs: DataFrame, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """The best successful row of each group (AGG-06); groups without success vanish."""
    order = Window.partitionBy(*keys).orderBy(F.desc("ari"), "view_rank")
    return runs.filter(succeeded()).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def collapse_best_view(runs: DataFrame) -> DataFrame:
    """Best row of each unit, or its first success, or its first row (AGG-05)."""
    order = Window.partitionBy(*UNIT).orderBy((F.col("status") != "success").cast("int"), F.desc_nulls_last("ari"), "view_rank")
    return runs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def dataset_level_frame(best: DataFrame) -> DataFrame:
    """Rank (method 'min'), distance to the best and best flag within each dataset (WIN-08, JOIN-06)."""
    whole = Window.partitionBy("dataset_id")
    top = F.max("best_ari").over(whole)
    return best.withColumns(
        {
            "rank_within_pool": F.when(F.col("best_ari").isNotNull(), F.rank().over(whole.orderBy(F.desc_nulls_last("best_ari")))),
            "delta_to_best": F.col("best_ari") - top,
            "is_best": F.coalesce(F.col("best_ari") == top, F.lit(False)),
        }
    )


def expected_grid(runs: DataFrame, views: tuple[str, ...] = ("x_only", "y_only", "xy_2d")) -> DataFrame:
    """Every dataset x method x view that should exist; the distinct keys are small dimensions."""
    methods = runs.select("method_name").distinct().agg(F.array_sort(F.collect_set("method_name")).alias("m"))
    view_list = F.array(*map(F.lit, views))
    grid = runs.select("dataset_id").distinct().join(F.broadcast(methods))
    return grid.select("dataset_id", F.explode("m").alias("method_name")).withColumn("view_id", F.explode(view_list))


def complete_frame(runs: DataFrame) -> DataFrame:
    """Missing cells of the grid become rows of status 'missing' (SRC-08)."""
    keys = [*UNIT, "view_id"]
    return expected_grid(runs).join(runs, keys, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def missing_runs(runs: DataFrame) -> DataFrame:
    """Cells of the grid without a run (JOIN-13, JOIN-14)."""
    return expected_grid(runs).join(runs, [*UNIT, "view_id"], "left_anti")
