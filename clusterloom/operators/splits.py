"""Stratified splits, seeds, apportionment and job plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derive_seed(*parts: Column | str | int) -> Column:
    """First four bytes of the SHA-256 of the parts joined by '|', below 2^31 (OBJ-21, GEN-04)."""
    text = F.concat_ws("|", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % F.lit(1 << 31)


def stratified_splits(index: DataFrame, stratum: str, id_col: str = "dataset_id", n_splits: int = 16, seed: int = 42) -> DataFrame:
    """index with split_id 1..n_splits: round robin within a stratum in md5 order from an md5 offset (GEN-01).

    The order is a documented variant of a seeded permutation.
    """
    digest = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")).cast("binary"))
    offset = F.conv(F.substr(digest(F.col(stratum)), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % n_splits
    order = Window.partitionBy(stratum).orderBy(digest(F.col(id_col)), id_col)
    return index.withColumn("split_id", ((F.row_number().over(order) - 1 + offset) % n_splits + 1).cast("int"))


def split_problems(splits: DataFrame, n_splits: int = 16, id_col: str = "dataset_id") -> DataFrame:
    """(problem, n): repeated datasets, ids out of range, uneven strata; empty when all is well (GEN-02)."""
    repeated = splits.groupBy(id_col).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated").alias("problem"), "n")
    outside = splits.filter((F.col("split_id") < 1) | (F.col("split_id") > n_splits) | F.col("split_id").isNull()).agg(F.count("*").alias("n")).select(F.lit("out_of_range").alias("problem"), "n")
    return repeated.unionByName(outside).filter("n > 0")


def apportion(shares: DataFrame, total: int, keys: Sequence[str] = (), share: str = "share", name: str = "name") -> DataFrame:
    """Whole numbers that sum to total, by largest remainder, ties by name (GEN-03)."""
    whole = Window.partitionBy(*keys)
    exact = F.col(share) / F.sum(share).over(whole) * total
    floored = shares.withColumn("_x", F.round(exact, 9)).withColumn("n", F.floor("_x"))
    ranked = floored.withColumns({"_left": F.lit(total) - F.sum("n").over(whole), "_r": F.row_number().over(whole.orderBy(F.desc(F.col("_x") - F.floor("_x")), name))})
    return ranked.withColumn("n", F.col("n") + (F.col("_r") <= F.col("_left")).cast("int")).drop("_x", "_left", "_r")


def expand_jobs(plan: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """A row per dataset to generate, numbered within the plan (GEN-05)."""
    jobs = plan.filter(F.col(count) > 0).withColumn("local_idx", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count).cast("bigint"))))
    return jobs.withColumn("job_id", F.row_number().over(Window.orderBy(*keys, "local_idx")))


def round_robin(items: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, out: str = "slot") -> DataFrame:
    """Items of a key dealt in turn over n regimes (RNK-11)."""
    return items.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) % n)


def regimes() -> list[tuple[str, str]]:
    """The ten regimes: source of the profile and size rule (RNK-06)."""
    return [(source, size) for source in ("mlp", "knn") for size in ("1", "3", "5", "10", "dynamic")]


def policies() -> list[tuple[str, str, str]]:
    """The twenty policies: regimes with raw or softmax weights (OBJ-26)."""
    return [(*r, w) for r in regimes() for w in ("raw", "softmax")]
