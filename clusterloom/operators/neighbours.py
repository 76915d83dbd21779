"""Nearest-neighbour joins and the prediction of utilities from neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metric_tree import NearestRows, TreeJoin, matrix
from .summaries import exact_percentiles

EXACT = 1e-12
#: Reference vectors that may be broadcast as one matrix, in bytes of doubles and in rows; queries are dealt out from so many rows.
BROADCAST_BYTES, BROADCAST_ROWS, DEALT = 32 << 20, 1 << 16, 4096
#: Distances that a step holds.
STEP = 1 << 21


def knn_join(queries: DataFrame, references: DataFrame, k: int, id_col: str, vector: str, metric: str = "euclidean", exclude_self: bool = True) -> DataFrame:
    """(query id, neighbour id, distance, position) of the k nearest references (JOIN-15, ML-03).

    The size of the references is checked: up to BROADCAST_BYTES and
    BROADCAST_ROWS they are one broadcast matrix, read through Arrow. Beyond
    that they go into the cells of a pivot tree, and a query visits only cells
    within its kth distance.
    """
    spark = queries.sparkSession
    facts = references.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if facts.n * (facts.d or 1) * 8 > BROADCAST_BYTES or facts.n > BROADCAST_ROWS:
        return TreeJoin(queries, references, k, id_col, vector, metric, exclude_self).found
    kind = queries.schema[id_col].dataType.simpleString()
    rows = references.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).toPandas()
    held = spark.sparkContext.broadcast((rows["id"].to_numpy(), matrix(rows["v"], facts.d or 1)))
    asks = queries.select(id_col, vector)
    asks = asks.repartition(2 * spark.sparkContext.defaultParallelism, id_col) if facts.n > DEALT else asks
    found = asks.mapInPandas(_nearest(held, k, metric, exclude_self), f"query_id {kind}, neighbour_id {kind}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def _nearest(held, k: int, metric: str, exclude_self: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = NearestRows(*held.value, k, metric, exclude_self)
        for batch in batches:
            yield from rows.steps(batch.iloc[:, 0].to_numpy(), matrix(batch.iloc[:, 1], rows.x.shape[1]), most=STEP)

    return run


def scaler(train: DataFrame, columns: Sequence[str], robust: bool = False) -> DataFrame:
    """One row of medians, centres and scales learned from the training rows only (ML-01)."""
    shares = (0.5, 0.25, 0.75) if robust else (0.5,)
    found = exact_percentiles(train, [(c, at) for c in columns for at in shares])
    out = []
    for i, c in enumerate(columns):
        middle, *sides = (F.lit(v).cast("double") for v in found[i * len(shares) : (i + 1) * len(shares)])
        centre = middle if robust else F.avg(F.coalesce(F.col(c), F.lit(None)))
        width = sides[1] - sides[0] if robust else F.stddev_pop(c)
        out += [F.coalesce(middle, F.lit(0.0)).alias(f"{c}_fill"), F.coalesce(centre, F.lit(0.0)).alias(f"{c}_centre"), F.when(width > EXACT, width).otherwise(1.0).alias(f"{c}_scale")]
    return train.agg(F.count("*").alias("_n"), *out).drop("_n")


def scale(rows: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with 'features': imputed, centred and scaled; what is still not finite becomes 0 (ML-02)."""
    x = lambda c: (F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.col(f"{c}_fill")) - F.col(f"{c}_centre")) / F.col(f"{c}_scale")
    clean = lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.coalesce(v, F.lit(0.0)))
    return rows.join(F.broadcast(fitted)).withColumn("features", F.array(*(clean(x(c)) for c in columns))).drop(*(f"{c}_{s}" for c in columns for s in ("fill", "centre", "scale")))


def predict_utilities(neighbours: DataFrame, utilities: DataFrame, weighting: str = "inverse", eps: float = 1e-9) -> DataFrame:
    """(query_id, metric_id, utility): weighted mean over neighbours, exact matches alone where there are any (ML-04, ML-05)."""
    met = neighbours.join(utilities.withColumnRenamed("dataset_id", "neighbour_id"), "neighbour_id")
    # Only neighbours that have the utility can decide it.
    exact, w = F.col("distance") <= EXACT, 1 / (F.col("distance") + eps) if weighting == "inverse" else F.lit(1.0)
    alone = F.sum(F.when(exact, F.col("utility"))) / F.nullif(F.sum(exact.cast("double")), F.lit(0.0))
    mean = F.when(F.max(exact), alone).otherwise(F.sum(w * F.col("utility")) / F.sum(w))
    return met.groupBy("query_id", "metric_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("utility"))


def loso_folds(splits: DataFrame) -> DataFrame:
    """(fold, dataset_id, role): each split is held out once (ML-08)."""
    ids = splits.agg(F.array_sort(F.collect_set("split_id")).alias("f"))
    return splits.join(F.broadcast(ids)).withColumn("fold", F.explode("f")).select("fold", "dataset_id", F.when(F.col("split_id") == F.col("fold"), "validation").otherwise("train").alias("role"))


def leakage(folds: DataFrame) -> DataFrame:
    """Datasets on both sides of a fold; empty when all is well (ML-09)."""
    return folds.groupBy("fold", "dataset_id").agg(F.countDistinct("role").alias("n")).filter("n > 1")


def one_se_rule(scores: DataFrame, config: Sequence[str] = ("config",), value: str = "score", simpler: Sequence[str] = ("n_neighbors",)) -> DataFrame:
    """The simplest configuration within one standard error of the best mean (ML-10, ML-11)."""
    per = scores.groupBy(*config, *simpler).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))
    whole = Window.partitionBy()
    best = F.max(F.struct("mean", F.coalesce("se", F.lit(0.0)).alias("s"))).over(whole)
    near = per.withColumn("_b", best).filter(F.col("mean") >= F.col("_b.mean") - F.col("_b.s"))
    return near.withColumn("_n", F.row_number().over(Window.orderBy(*simpler, F.desc("mean"), *config))).filter("_n = 1").drop("_n", "_b")
