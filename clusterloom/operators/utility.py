"""Utility of a validity index: how well its values order candidates by agreement with the truth.

Long frames: a row per group, candidate and metric with score and relevance.
Candidate pairs meet within one group only; a group is a slate of fixed size
(32 in the protocol), and its pairs grow with the square of that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import average_rank

# Weights of the utility target's parts.
WEIGHTS = {"spearman": 0.18, "kendall": 0.12, "pairwise": 0.20, "ndcg": 0.20, "overlap_top": 0.05, "overlap_bottom": 0.05, "ndcg_5": 0.10, "ndcg_10": 0.10}
MIN_ROWS, MIN_SHARE = 10, 0.2


def positions(df: DataFrame, keys: Sequence[str], score: str, index: str, out: str, ascending: bool = False) -> DataFrame:
    """Stable positions from 1, ties by index (FN-28, FN-29, WIN-21)."""
    order = F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order, index)))


def dcg(position: str, relevance: Column, k: int | None = None, exponential: bool = True) -> Column:
    """Discounted gain; 2^rel - 1 in the utility target, linear in evaluation (FN-25, FN-39)."""
    gain = (F.pow(F.lit(2.0), relevance) - 1) if exponential else relevance
    term = gain / F.log2(F.col(position) + 1.0)
    return F.sum(F.when(F.col(position) <= k, term).otherwise(0.0) if k else term)


def ndcg(df: DataFrame, keys: Sequence[str], score: str = "score", relevance: str = "relevance", index: str = "candidate", k: int | None = None, exponential: bool = True) -> DataFrame:
    """(keys, ndcg) of the score's order; 0 where the ideal gain is 0 (FN-25, FN-26, FN-39)."""
    ranked = positions(positions(df, keys, score, index, "_by_score"), keys, relevance, index, "_ideal")
    rel = F.col(relevance)
    best = dcg("_ideal", rel, k, exponential)
    return ranked.groupBy(*keys).agg(F.when(best > 0, dcg("_by_score", rel, k, exponential) / best).otherwise(0.0).alias("ndcg"))


def overlap(df: DataFrame, keys: Sequence[str], k: int, ascending: bool = False, score: str = "score", relevance: str = "relevance", index: str = "candidate") -> DataFrame:
    """Share of the k extreme rows that both orders have (SET-06, FN-28, FN-29)."""
    both = positions(positions(df, keys, score, index, "_a", ascending), keys, relevance, index, "_b", ascending)
    n = F.least(F.lit(k), F.count("*"))
    return both.groupBy(*keys).agg((F.count_if((F.col("_a") <= k) & (F.col("_b") <= k)) / n).alias("overlap"))


def spearman(df: DataFrame, keys: Sequence[str], x: str = "score", y: str = "relevance") -> DataFrame:
    """Correlation of average ranks (ST-27); NULL where a side is constant."""
    ranked = df.withColumns({"_x": average_rank(keys, x), "_y": average_rank(keys, y)})
    rho = F.corr("_x", "_y")
    return ranked.groupBy(*keys).agg(F.when((F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0), rho).alias("spearman"))


def candidate_pairs(df: DataFrame, keys: Sequence[str], x: str = "score", y: str = "relevance", index: str = "candidate") -> DataFrame:
    """(keys, dx, dy) of each unordered pair of a group's rows."""
    side = df.select(*keys, index, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    other = side.select(*keys, F.col(index).alias("_j"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    met = side.join(other, list(keys)).filter(F.col(index) < F.col("_j"))
    return met.select(*keys, F.signum(F.col("_x") - F.col("_x2")).alias("dx"), F.signum(F.col("_y") - F.col("_y2")).alias("dy"))


def pair_scores(df: DataFrame, keys: Sequence[str], x: str = "score", y: str = "relevance", index: str = "candidate") -> DataFrame:
    """(keys, kendall tau-b, pairwise accuracy over pairs with different relevance) (FN-27, FN-38)."""
    s = F.col("dx") * F.col("dy")
    untied_x, untied_y = F.count_if(F.col("dx") != 0), F.count_if(F.col("dy") != 0)
    decided = F.col("dy") != 0
    return candidate_pairs(df, keys, x, y, index).groupBy(*keys).agg(
        F.when((untied_x > 0) & (untied_y > 0), F.sum(s) / F.sqrt(untied_x.cast("double") * untied_y)).alias("kendall"),
        F.coalesce(F.avg(F.when(decided, F.when(s > 0, 1.0).when(s == 0, 0.5).otherwise(0.0))), F.lit(0.0)).alias("pairwise"),
    )


def utility_score(df: DataFrame, keys: Sequence[str], k_share: float = 0.2, index: str = "candidate") -> DataFrame:
    """The weighted utility target in [0, 1] of each group (FN-30).

    Rows need a finite score and relevance; groups with fewer than MIN_ROWS
    rows, or than MIN_SHARE of their rows, have no utility.
    """
    total = Window.partitionBy(*keys)
    usable = df.withColumn("_all", F.count("*").over(total)).filter("score is not null and relevance is not null")
    usable = usable.withColumn("_n", F.count("*").over(total)).filter((F.col("_n") >= F.greatest(F.lit(float(MIN_ROWS)), MIN_SHARE * F.col("_all"))))
    k = F.greatest(F.lit(1), F.ceil(k_share * F.col("_n")).cast("int"))
    cut = usable.withColumn("_k", k)
    ranked = cut
    for column, by, ascending in (("_s", "score", False), ("_r", "relevance", False), ("_sb", "score", True), ("_rb", "relevance", True)):
        ranked = positions(ranked, keys, by, index, column, ascending)
    ranked = ranked.withColumns({"_x": average_rank(keys, "score"), "_y": average_rank(keys, "relevance")})
    rel = F.col("relevance")

    def share(k: int | None) -> Column:
        ideal = dcg("_r", rel, k)
        return F.when(ideal > 0, dcg("_s", rel, k) / ideal).otherwise(0.0)

    both = lambda a, b: F.count_if((F.col(a) <= F.col("_k")) & (F.col(b) <= F.col("_k"))) / F.max("_k")
    rho = F.when((F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0), F.corr("_x", "_y"))
    one = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.greatest(F.lit(0.0), F.coalesce(rho, F.lit(0.0))).alias("spearman"), share(None).alias("ndcg"), both("_s", "_r").alias("overlap_top"), both("_sb", "_rb").alias("overlap_bottom"), share(5).alias("ndcg_5"), share(10).alias("ndcg_10")
    )
    pairs = pair_scores(cut, keys, index=index).withColumn("kendall", F.greatest(F.lit(0.0), F.coalesce("kendall", F.lit(0.0))))
    score = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    return one.join(pairs, list(keys)).withColumn("utility", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def regression_errors(df: DataFrame, keys: Sequence[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """MSE, RMSE, MAE and R2 (FN-35, FN-44)."""
    e = F.col(predicted) - F.col(truth)
    spread = F.var_pop(truth) * F.count("*")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 1 for two empty ones (SET-07, SET-08)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def top_set_similarity(df: DataFrame, group: str, k: int = 5, score: str = "utility", name: str = "metric_id") -> DataFrame:
    """(a, b, jaccard) of the top-k sets of all groups; groups are few (SET-09)."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), name)
    sets = df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).groupBy(group).agg(F.collect_set(name).alias("s"))
    other = sets.select(F.col(group).alias("b"), F.col("s").alias("t"))
    return sets.select(F.col(group).alias("a"), "s").join(other, F.col("a") < F.col("b")).select("a", "b", jaccard(F.col("s"), F.col("t")).alias("jaccard"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, NULL for a zero vector (FN-43)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
