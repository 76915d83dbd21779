"""Paired comparisons of methods, win rates, gaps and dominance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .summaries import q


def paired_values(best: DataFrame, a: str, b: str, value: str = "best_ari") -> DataFrame:
    """(dataset_id, value_a, value_b, delta) where both methods have a value (JOIN-01 to JOIN-04).

    One aggregation over the two methods' rows instead of a self-join.
    """
    pick = lambda m: F.max(F.when(F.col("method_name") == m, F.col(value)))
    both = best.filter(F.col("method_name").isin(a, b)).groupBy("dataset_id").agg(pick(a).alias("value_a"), pick(b).alias("value_b"))
    return both.filter("value_a is not null and value_b is not null").withColumn("delta", F.col("value_a") - F.col("value_b"))


def all_pairs(best: DataFrame, keys: Sequence[str] = (), value: str = "best_ari") -> DataFrame:
    """(keys, method, baseline, dataset_id, delta): a dataset's methods meet through arrays of that dataset only."""
    entry = F.struct(F.col("method_name").alias("m"), F.col(value).alias("v"))
    per = best.filter(F.col(value).isNotNull()).groupBy("dataset_id", *keys).agg(F.collect_list(entry).alias("all"))
    met = per.withColumn("a", F.explode("all")).withColumn("b", F.explode("all")).filter("a.m <> b.m")
    return met.select(*keys, "dataset_id", F.col("a.m").alias("method"), F.col("b.m").alias("baseline"), (F.col("a.v") - F.col("b.v")).alias("delta"))


def win_columns(eps: float) -> list:
    d = F.col("delta")
    return [
        F.count("*").alias("n_pairs"),
        F.count_if(d > eps).alias("wins"),
        F.count_if(F.abs(d) <= eps).alias("ties"),
        F.count_if(d < -eps).alias("losses"),
        F.avg((d > eps).cast("double")).alias("win_rate"),
        F.avg(d).alias("gain_mean"),
        q(d, 0.5).alias("gain_median"),
        q(d, 0.25).alias("gain_q25"),
        q(d, 0.75).alias("gain_q75"),
    ]


def winrates(best: DataFrame, keys: Sequence[str] = (), eps: float = 1e-6) -> DataFrame:
    """Win, tie and loss counts and gains of all ordered pairs (ST-13 to ST-16)."""
    return all_pairs(best, keys).groupBy(*keys, "method", "baseline").agg(*win_columns(eps))


def paired_gap(best: DataFrame, reference: str, other: str) -> DataFrame:
    """One row: reference minus other (PF-17)."""
    d = F.col("delta")
    return paired_values(best, reference, other).agg(
        F.count("*").alias("n"), F.avg(d).alias("gap_mean"), q(d, 0.5).alias("gap_median"), F.stddev_samp(d).alias("gap_std"), F.avg((d > 0).cast("double")).alias("positive_share")
    )


def view_gap(best: DataFrame, keys: Sequence[str] = ("method_name",)) -> DataFrame:
    """Best minus mean view (PF-22)."""
    gap = F.col("best_ari") - F.col("view_mean")
    return best.filter("best_ari is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg(gap).alias("gap_mean"), q(gap, 0.5).alias("gap_median"), F.max(gap).alias("gap_max"))


def pareto_frontier(points: DataFrame, cost: str, gain: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows that no cheaper row equals or beats (WIN-24), by a running maximum."""
    before = Window.partitionBy(*keys).orderBy(cost, F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(gain).over(before)
    return points.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col(gain) > F.col("_best") + 1e-15)).drop("_best")


def dominators(points: DataFrame, name: str, cost: str, gain: str, most: int = 4) -> DataFrame:
    """Up to `most` rows that dominate each dominated row (JOIN-17). points is a summary: a row a method."""
    a, b = points.alias("a"), points.alias("b")
    better = (F.col(f"b.{cost}") <= F.col(f"a.{cost}")) & (F.col(f"b.{gain}") >= F.col(f"a.{gain}")) & (F.col(f"a.{name}") != F.col(f"b.{name}"))
    found = a.join(b, better).groupBy(F.col(f"a.{name}").alias(name))
    return found.agg(F.slice(F.array_sort(F.collect_set(F.col(f"b.{name}"))), 1, most).alias("dominated_by"))
