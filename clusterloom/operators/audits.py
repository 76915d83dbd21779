"""Audits of a run repository: counts, coverage, failures, splits and fixed candidate slates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import dynamic_k


def repository_counts(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(table_name, n_rows, n_keys) of named tables with their key columns (AGG-31)."""
    counted = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.countDistinct(*keys).alias("n_keys")) for name, (df, keys) in tables.items()]
    return reduce(DataFrame.union, counted)


def config_coverage(evaluations: DataFrame, record: str, config: str, expected: int = 32) -> DataFrame:
    """Records whose number of configurations is not the expected one (AGG-33)."""
    return evaluations.groupBy(record).agg(F.countDistinct(config).alias("n_configs")).filter(F.col("n_configs") != expected)


def family_coverage(records: DataFrame, evaluations: DataFrame, failures: DataFrame, record: str, family: str = "family") -> DataFrame:
    """Records, evaluations and failures by family (AGG-34): the facts are counted by record before they meet."""
    n = lambda df, name: df.groupBy(record).agg(F.count("*").alias(name))
    met = records.select(record, family).join(n(evaluations, "e"), record, "left").join(n(failures, "f"), record, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return met.groupBy(family).agg(F.count("*").alias("n_records"), total("e").alias("n_evaluations"), total("f").alias("n_failures"), F.count_if(F.col("e").isNull()).alias("n_empty"))


def failure_analysis(failures: DataFrame, by: Sequence[str]) -> DataFrame:
    """Failures by stage, algorithm and reason with their share (AGG-37)."""
    return failures.groupBy(*by).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def split_summary(datasets: DataFrame, split: str = "split_id") -> DataFrame:
    """Datasets, families and subfamilies of each split (AGG-39)."""
    return datasets.groupBy(split).agg(F.count("*").alias("n_rows"), F.countDistinct("dataset_id").alias("n_datasets"), F.countDistinct("family").alias("n_families"), F.countDistinct("subfamily").alias("n_subfamilies"))


def keep_splits(datasets: DataFrame, splits: Sequence[int], split: str = "split_id") -> DataFrame:
    """Rows whose split is among those declared (FLT-12, FLT-13)."""
    return datasets.filter(F.col(split).isin(*splits))


def dynamic_k_distribution(utilities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram of the dynamically selected K (AGG-42)."""
    return dynamic_k(utilities, keys).groupBy("k").agg(F.count("*").alias("n"))


def job_counts(plan: DataFrame) -> DataFrame:
    """Jobs by subfamily and cluster count, by subfamily, and in all (AGG-47): one rollup."""
    return plan.rollup("subfamily", "cluster_count").agg(F.count("*").alias("n_jobs"), F.grouping_id().alias("level"))


def best_algorithm(evaluations: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Algorithm of each record's valid configuration with the highest ARI, ties to the smaller configuration (AGG-48).

    evaluations: record_id, config_id, algorithm, ari, valid_result.
    """
    order = Window.partitionBy("record_id").orderBy(F.desc("ari"), "config_id")
    first = evaluations.filter("valid_result and ari is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    out = first.select("record_id", F.col("algorithm").alias("best_algorithm"), F.col("config_id").alias("best_config_id"), F.col("ari").alias("best_ari"))
    return out.join(records.dropDuplicates(["record_id"]), "record_id", "left") if records is not None else out


def ari_regression_rows(evaluations: DataFrame, records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row a valid evaluation with the candidate metrics it has, its ARI and the record's family (BL-04)."""
    held = [m for m in metrics if m in evaluations.columns]
    meta = records.dropDuplicates(["record_id"]).select("record_id", "family", "subfamily")
    return evaluations.filter("valid_result and ari is not null").select("record_id", "config_id", "algorithm", "ari", *held).join(meta, "record_id", "left")


def slate_problems(candidates: DataFrame, keys: Sequence[str], identity: Sequence[str], norms: Sequence[Column | str], expected: int = 32) -> DataFrame:
    """(keys, problem) of fixed candidate sets that break the contract (OBJ-24): number, identity, and finite values of valid rows."""
    bad = reduce(lambda a, b: a | b, (F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)) for c in (F.col(n) if isinstance(n, str) else n for n in norms)))
    per = candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(*identity).alias("d"), F.count_if(F.col("valid") & bad).alias("b"))
    found = F.array_compact(F.array(F.when(F.col("n") != expected, F.lit("count")), F.when(F.col("d") != F.col("n"), F.lit("identity")), F.when(F.col("b") > 0, F.lit("not_finite"))))
    return per.select(*keys, F.explode(found).alias("problem"))


def eligible(trials: DataFrame, min_clusters: int = 2) -> DataFrame:
    """Rows of an online trial log that may be chosen (FLT-04): valid, with an objective and two clusters or more."""
    return trials.filter(F.col("valid") & F.col("objective").isNotNull() & (F.col("n_clusters") >= min_clusters))


def warmstart(candidates: DataFrame, keys: Sequence[str], config: str = "candidate") -> DataFrame:
    """Configurations of each record ranked by ARI, NULL last, ties by configuration (WIN-07, JOIN-18)."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("ari"), config)
    return candidates.withColumn("position", F.row_number().over(order))


def methods_where(registry: Sequence[Mapping], **criteria) -> list[str]:
    """Names of registered methods whose fields have the given values, in registry order (FLT-14)."""
    return [m["method_name"] for m in registry if all(m.get(k) == v for k, v in criteria.items())]


def select_methods(registry: Sequence[Mapping], names: Sequence[str] | None = None) -> list[Mapping]:
    """Registered methods of these names, in registry order; all without names. Unknown names are an error (FLT-15)."""
    if unknown := set(names or ()) - {m["method_name"] for m in registry}:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    return [m for m in registry if names is None or m["method_name"] in names]


def metric_key(c: Column, registry: Mapping[str, str]) -> Column:
    """Registry key of a metric's display name: the name itself, without case, blanks or dashes, or its alias; NULL where unknown (FLT-10)."""
    plain = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    known = F.create_map(*(F.lit(x) for name, key in registry.items() for x in (name, key)))
    return F.coalesce(F.element_at(known, c), F.element_at(known, plain), F.when(plain.isin(*set(registry.values())), plain))
