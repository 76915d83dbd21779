"""Grouped summaries of run and best-view frames: one aggregation each, map-side combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import succeeded


def q(c: Column | str, at: float) -> Column:
    """Linear-interpolated percentile (FN-06)."""
    return F.percentile(c, F.lit(at))


#: Accuracy of the sketches that bracket exact percentiles.
ACCURACY = 2_000


def exact_percentiles(df: DataFrame, wanted: Sequence[tuple[str, float]]) -> list[float | None]:
    """q() of (column, share) pairs over the whole table, of which no task reads all values.

    Sketches bracket each percentile; values between the edges, some thousandth
    of the rows, are counted and ranked. Where an edge misses, q() decides.
    """
    value, off = [F.col(c).cast("double") for c, _ in wanted], 2 / ACCURACY
    sketched = [F.percentile_approx(v, F.array(F.lit(max(0.0, at - off)), F.lit(min(1.0, at + off))), F.lit(ACCURACY)).alias(f"e{i}") for i, (v, (_, at)) in enumerate(zip(value, wanted, strict=True))]
    told = df.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(value)), *sketched).first()
    held = [i for i in range(len(wanted)) if told[f"n{i}"]]
    found: list[float | None] = [None] * len(wanted)
    if not held:
        return found
    below = df.agg(*(F.count_if(value[i] < told[f"e{i}"][0]).alias(f"b{i}") for i in held)).first()
    inside = F.array(*(F.when(value[i].between(*told[f"e{i}"]), F.struct(F.lit(i).alias("i"), value[i].alias("v"))) for i in held))
    counted = df.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
    place = {i: wanted[i][1] * (told[f"n{i}"] - 1) for i in held}
    ranks = F.array(*(F.struct(F.lit(int(place[i])).cast("long").alias("low"), F.lit(-int(-place[i] // 1)).cast("long").alias("high"), F.lit(below[f"b{i}"]).cast("long").alias("below")) if i in place else F.lit(None) for i in range(len(wanted))))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v")) + ranks[F.col("i")]["below"]
    at = lambda c: F.min(F.when(F.col("_upto") > ranks[F.col("i")][c], F.col("v"))).alias(c)
    for r in counted.withColumn("_upto", upto).groupBy("i").agg(at("low"), at("high")).collect():
        if below[f"b{r.i}"] <= int(place[r.i]) and r.low is not None and r.high is not None:
            part = place[r.i] - int(place[r.i])
            found[r.i] = r.low if r.low == r.high else (1 - part) * r.low + part * r.high
    missed = [i for i in held if found[i] is None]
    if missed:
        for i, v in zip(missed, df.agg(*(q(value[i], wanted[i][1]) for i in missed)).first(), strict=True):
            found[i] = v
    return found


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def summary_columns() -> list[Column]:
    """The summary block of a run frame (AGG-01): counts, rates, ARI, runtime and K statistics."""
    ok = succeeded()
    ari = F.when(ok, F.col("ari"))
    run = F.when(ok, F.col("runtime_sec"))
    off = F.when(ok, F.col("selected_k") - F.col("true_k"))
    return [
        F.count("*").alias("n_runs"),
        F.countDistinct("dataset_id").alias("n_datasets"),
        F.count(ari).alias("n_success"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        _share(ok).alias("success_rate"),
        F.avg(ari).alias("ari_mean"),
        q(ari, 0.5).alias("ari_median"),
        F.stddev_samp(ari).alias("ari_std"),
        q(ari, 0.25).alias("ari_q25"),
        q(ari, 0.75).alias("ari_q75"),
        F.min(ari).alias("ari_min"),
        F.max(ari).alias("ari_max"),
        F.avg(run).alias("runtime_mean"),
        q(run, 0.5).alias("runtime_median"),
        q(run, 0.9).alias("runtime_p90"),
        _share(off == 0).alias("k_accuracy"),
        F.avg(F.abs(off)).alias("k_abs_error"),
        _share(off > 0).alias("k_over_rate"),
        _share(off < 0).alias("k_under_rate"),
    ]


def summarize_by(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The block per group; NULL groups stay, unknown keys are ignored (AGG-03)."""
    return runs.groupBy(*(k for k in keys if k in runs.columns)).agg(*summary_columns())


def standard_summaries(runs: DataFrame, keys: Sequence[str] = ("family", "view_id", "true_k")) -> DataFrame:
    """All fixed groupings in one pass over the data (AGG-04): GROUPING SETS by method."""
    sets = [["method_name"], *(["method_name", k] for k in keys)]
    marks = F.concat_ws("+", *(F.when(F.grouping(k) == 0, k) for k in keys))
    columns = [F.col("method_name"), *map(F.col, keys)]
    grouped = runs.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(marks.alias("grouping"), F.count("*").alias("n_runs"), F.avg(F.when(succeeded(), F.col("ari"))).alias("ari_mean"))


def summarize_methods(best: DataFrame, keys: Sequence[str] = ("method_name",)) -> DataFrame:
    """The block of best-view rows (AGG-10 to AGG-12)."""
    return best.groupBy(*keys).agg(
        F.count("*").alias("n_datasets"),
        F.count("best_ari").alias("n_success"),
        F.avg("best_ari").alias("best_ari_mean"),
        q("best_ari", 0.5).alias("best_ari_median"),
        F.stddev_samp("best_ari").alias("best_ari_std"),
        q("best_ari", 0.25).alias("best_ari_q25"),
        q("best_ari", 0.75).alias("best_ari_q75"),
        F.sum("total_runtime_sec").alias("total_runtime_sec"),
        q("best_runtime_sec", 0.9).alias("runtime_p90"),
        _share(F.col("best_view") == "x_only").alias("x_only_share"),
        F.bool_and(F.col("n_success") == F.col("n_views")).alias("all_views_ok"),
    )


def k_accuracy(runs: DataFrame, keys: Sequence[str] = ("method_name",)) -> DataFrame:
    """How often and how far the selected K misses (AGG-13, AGG-14)."""
    off = F.col("selected_k") - F.col("true_k")
    return runs.filter(succeeded()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        _share(off == 0).alias("k_accuracy"),
        F.avg(F.abs(off)).alias("k_mae"),
        F.avg(off).alias("k_bias"),
        _share(off > 0).alias("over_rate"),
        _share(off < 0).alias("under_rate"),
    )


def k_confusion(runs: DataFrame) -> DataFrame:
    """Long cross-tab of true and selected K by method (AGG-15, AGG-16)."""
    return runs.filter(succeeded()).groupBy("method_name", "true_k", "selected_k").agg(F.count("*").alias("n"))


def coverage_audit(runs: DataFrame, expected_views: int = 3) -> DataFrame:
    """Datasets, views and run states per method (AGG-30)."""
    return runs.groupBy("method_name").agg(
        F.countDistinct("dataset_id").alias("n_datasets"),
        F.countDistinct("view_id").alias("n_views"),
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "missing").alias("n_missing"),
        (F.countDistinct("view_id") == expected_views).alias("views_complete"),
    )


def win_rates(best: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Shares of first places: methods within tol of a dataset's maximum share one win (AGG-41)."""
    whole = Window.partitionBy("dataset_id")
    won = best.filter("best_ari is not null").withColumn("won", F.col("best_ari") >= F.max("best_ari").over(whole) - tol)
    shared = won.withColumn("share", F.when(F.col("won"), 1.0 / F.count_if("won").over(whole)).otherwise(0.0))
    return shared.groupBy("method_name").agg(F.sum("share").alias("wins"), F.countDistinct("dataset_id").alias("n_datasets"), F.avg("share").alias("win_rate"))


def view_means(runs: DataFrame, value: str = "ari") -> DataFrame:
    """Mean of the views per dataset and method: the dataset is the unit of inference (AGG-43)."""
    return runs.filter(succeeded()).groupBy("dataset_id", "method_name").agg(F.avg(value).alias("value"))


def metric_usage(selections: DataFrame) -> DataFrame:
    """Usage of each selected metric: runs, share of runs and of slots, weight mass (AGG-19, AGG-24).

    selections: run_id, metric_id, weight.
    """
    # Distinct runs are groups: where selections lie together by run, rows don't travel again.
    total = selections.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.count("run_id").alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("slots"))
    each = selections.groupBy("run_id", "metric_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.count("weight").alias("c"))
    per = each.groupBy("metric_id").agg(F.count("run_id").alias("n_runs"), F.sum("n").alias("n_slots"), (F.sum("w") / F.nullif(F.sum("c"), F.lit(0))).alias("weight_mean"), F.sum("w").alias("weight_mass"))
    return per.join(F.broadcast(total)).select("metric_id", "n_runs", "n_slots", (F.col("n_runs") / F.col("runs")).alias("run_share"), (F.col("n_slots") / F.col("slots")).alias("slot_share"), "weight_mean", "weight_mass")


def category_usage(selections: DataFrame, catalog: DataFrame) -> DataFrame:
    """The same per category of metric, with the median number per run (AGG-20, AGG-25)."""
    placed = selections.join(F.broadcast(catalog), "metric_id").groupBy("category", "run_id").agg(F.count("*").alias("n"), F.sum("weight").alias("mass"))
    mass = F.sum(F.sum("mass")).over(Window.partitionBy())
    return placed.groupBy("category").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n_slots"), q("n", 0.5).alias("median_per_run"), F.sum("mass").alias("weight_mass"), (F.sum("mass") / mass).alias("mass_share"))


def top_metric_frequency(selections: DataFrame) -> DataFrame:
    """How often a metric has a run's largest weight, ties to the smaller name (AGG-21)."""
    order = Window.partitionBy("run_id").orderBy(F.desc("weight"), "metric_id")
    first = selections.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return first.groupBy("metric_id").agg(F.count("*").alias("n_top"))


def weight_entropy(selections: DataFrame) -> DataFrame:
    """Entropy of each run's weights over ln(n); 0 for a single weight (FN-31, AGG-22, AGG-28)."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("run_id"))
    return selections.withColumn("p", share).groupBy("run_id").agg(
        F.count("*").alias("n_metrics"),
        F.when(F.count("*") > 1, -F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0)) / F.ln(F.count("*"))).otherwise(0.0).alias("entropy"),
    )


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long counts of two columns (AGG-38)."""
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL share and range of each numeric column, long (AGG-35, AGG-36): one pass and an unpivot."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")
    return df.select(stacked).groupBy("x.column_name").agg(
        F.count("*").alias("n"), _share(F.col("x.value").isNull()).alias("null_rate"), F.min("x.value").alias("least"), F.max("x.value").alias("most")
    )


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (AGG-32)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
