"""Paired tests, multiple-testing corrections and factorial effects."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import average_rank


def signed_ranks(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """(keys, n, w_plus, w_minus, rank_biserial) with zeros dropped and average ranks (ST-03, ST-07)."""
    moved = deltas.filter(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn("_size", F.abs(value))
    ranked = moved.withColumn("_rank", average_rank(keys, "_size"))
    plus, minus = F.sum(F.when(F.col(value) > 0, F.col("_rank")).otherwise(0.0)), F.sum(F.when(F.col(value) < 0, F.col("_rank")).otherwise(0.0))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), ((plus - minus) / (plus + minus)).alias("rank_biserial"))


def signed_rank_p(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """signed_ranks() with z and the two-sided normal p, corrected for ties (ST-03, ST-20)."""
    moved = deltas.filter(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn("_size", F.abs(value))
    ties = moved.groupBy(*keys, "_size").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n")
    joined = signed_ranks(deltas, keys, value).join(ties, list(keys))
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(spread > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / spread)
    tail = F.pandas_udf(_normal_two_sided, "double")
    return joined.withColumn("z", z).withColumn("p_value", tail("z")).drop("ties")


def _normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None).astype("float64")


def effect_sizes(deltas: DataFrame, keys: Sequence[str], eps: float = 1e-3, value: str = "delta") -> DataFrame:
    """Mean, standardised mean and win/tie/loss counts (ST-04, ST-06)."""
    d = F.col(value)
    return deltas.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.when(F.stddev_samp(d) > 0, F.avg(d) / F.stddev_samp(d)).alias("dz"), F.count_if(d >= eps).alias("wins"), F.count_if(F.abs(d) < eps).alias("ties"), F.count_if(d <= -eps).alias("losses")
    )


def holm(tests: DataFrame, family: Sequence[str], p: str = "p_value", name: str = "hypothesis") -> DataFrame:
    """Holm-adjusted p within each family: running maximum, at most 1 (ST-10)."""
    order = Window.partitionBy(*family).orderBy(p, name)
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def bh_fdr(tests: DataFrame, family: Sequence[str], p: str = "p_value", name: str = "hypothesis") -> DataFrame:
    """Benjamini-Hochberg q-values: running minimum from the largest p (ST-18)."""
    up = Window.partitionBy(*family).orderBy(p, name)
    down = Window.partitionBy(*family).orderBy(F.desc(p), F.desc(name)).rowsBetween(Window.unboundedPreceding, 0)
    step = F.col(p) * F.count("*").over(Window.partitionBy(*family)) / F.row_number().over(up)
    return tests.withColumn("_step", F.least(F.lit(1.0), step)).withColumn("q_value", F.min("_step").over(down)).drop("_step")


def factorial_effects(arms: DataFrame, unit: str, a: str, b: str, value: str) -> DataFrame:
    """Main effects and interaction of a 2 x 2 design per unit (ST-25)."""
    at = lambda i, j: F.max(F.when((F.col(a) == i) & (F.col(b) == j), F.col(value)))
    cells = arms.groupBy(unit).agg(*(at(i, j).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)))
    whole = cells.filter(" and ".join(f"c{i}{j} is not null" for i in (0, 1) for j in (0, 1)))
    return whole.select(unit, ((F.col("c10") + F.col("c11") - F.col("c00") - F.col("c01")) / 2).alias("effect_a"), ((F.col("c01") + F.col("c11") - F.col("c00") - F.col("c10")) / 2).alias("effect_b"), (F.col("c11") - F.col("c10") - F.col("c01") + F.col("c00")).alias("interaction"))
