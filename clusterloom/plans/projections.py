"""Run, trial, selection and point frames projected from the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a part of the selections.
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per user (dataset), event type (method) and view, the first event of each."""
    view = F.col("event_id") % 3
    failed = F.col("event_id") % 17 == 0
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("dataset_id"),
        F.col("event_type").alias("method_name"),
        F.when(view == 0, "x_only").when(view == 1, "y_only").otherwise("xy_2d").alias("view_id"),
        view.cast("int").alias("view_rank"),
        F.when(~failed, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 250.0))).alias("ari"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("double").alias("runtime_sec"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        (2 + F.col("event_id") % 4).alias("selected_k"),
        (2 + F.col("user_id") % 4).alias("true_k"),
        (F.col("user_id") % 12).alias("family"),
    )
    columns = [c for c in raw.columns if c not in {"event_id", "dataset_id", "method_name", "view_id"}]
    first = raw.groupBy("dataset_id", "method_name", "view_id").agg(F.min_by(F.struct(*columns), "event_id").alias("r"))
    return first.select("dataset_id", "method_name", "view_id", "r.*")


RUNS_SQL = """runs AS (
    SELECT dataset_id, method_name, view_id, view_rank, ari, runtime_sec, status, selected_k, true_k, family FROM (
        SELECT user_id AS dataset_id, event_type AS method_name,
            CASE event_id % 3 WHEN 0 THEN 'x_only' WHEN 1 THEN 'y_only' ELSE 'xy_2d' END AS view_id,
            CAST(event_id % 3 AS INTEGER) AS view_rank,
            CASE WHEN event_id % 17 = 0 THEN NULL ELSE greatest(0.0, least(1.0, value / 250.0)) END AS ari,
            TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS runtime_sec,
            CASE WHEN event_id % 17 = 0 THEN 'failed' ELSE 'success' END AS status,
            2 + event_id % 4 AS selected_k, 2 + user_id % 4 AS true_k, user_id % 12 AS family,
            row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY event_id) AS rn
        FROM events) WHERE rn = 1)"""

BEST_SQL = RUNS_SQL + """,
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY dataset_id, method_name ORDER BY (ari IS NULL), ari DESC, runtime_sec ASC NULLS LAST, view_rank) AS rn FROM runs),
best AS (
    SELECT dataset_id, method_name, max(CASE WHEN rn = 1 THEN ari END) AS best_ari,
        max(CASE WHEN rn = 1 AND ari IS NOT NULL THEN view_id END) AS best_view,
        max(CASE WHEN rn = 1 AND ari IS NOT NULL THEN runtime_sec END) AS best_runtime_sec,
        sum(runtime_sec) AS total_runtime_sec, count(*) AS n_views, count(ari) AS n_success,
        avg(ari) AS view_mean, median(ari) AS view_median, min(ari) AS view_min, min(family) AS family, min(true_k) AS true_k
    FROM ranked GROUP BY 1, 2)"""


def trial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, candidate, ari, valid, metric_id, score): 32 candidates a supplier, four metrics each, long."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_linestatus"
    )
    first = lines.withColumn("candidate", F.row_number().over(order)).filter("candidate <= 32")
    metric = lambda n, c: F.struct(F.lit(n).alias("metric_id"), c.alias("score"))
    metrics = F.array(metric("m_price", F.col("l_extendedprice") / 100000.0), metric("m_quantity", F.col("l_quantity") / 50.0), metric("m_tax", F.col("l_tax") * 10.0), metric("m_discount", F.col("l_discount") * 5.0))
    return first.select(
        F.col("l_suppkey").alias("dataset_id"), "candidate", F.least(F.lit(1.0), F.col("l_discount") * 10).alias("ari"), (F.col("l_linestatus") == "F").alias("valid"), F.explode(metrics).alias("m")
    ).select("dataset_id", "candidate", "ari", "valid", "m.*")


TRIALS_SQL = """wide AS (
    SELECT * FROM (SELECT l_suppkey AS dataset_id,
            row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS candidate,
            least(1.0, l_discount * 10) AS ari, l_linestatus = 'F' AS valid,
            l_extendedprice / 100000.0 AS m_price, l_quantity / 50.0 AS m_quantity, l_tax * 10.0 AS m_tax, l_discount * 5.0 AS m_discount
        FROM lineitem) WHERE candidate <= 32),
trials AS (
    SELECT dataset_id, candidate, ari, valid, 'm_price' AS metric_id, m_price AS score FROM wide
    UNION ALL SELECT dataset_id, candidate, ari, valid, 'm_quantity', m_quantity FROM wide
    UNION ALL SELECT dataset_id, candidate, ari, valid, 'm_tax', m_tax FROM wide
    UNION ALL SELECT dataset_id, candidate, ari, valid, 'm_discount', m_discount FROM wide)"""


def utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, metric_id, utility): the mean score of each metric, rounded, so that equal values tie on both sides."""
    return trial_metrics(spark, sf_dir).groupBy("dataset_id", "metric_id").agg(F.round(F.avg("score"), 6).alias("utility"))


UTILITIES_SQL = TRIALS_SQL + """,
utilities AS (SELECT dataset_id, metric_id, round(avg(score), 6) AS utility FROM trials GROUP BY 1, 2)"""


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, metric_id, weight): an order selects its line flags, weighted by quantity."""
    read = table(spark, sf_dir, "lineitem")
    # As many parts as the rows ask for: what a task holds doesn't grow with the table.
    parts = max(spark.sparkContext.defaultParallelism, -(-read.count() // TASK_ROWS))
    own = read.select(F.col("l_orderkey").alias("run_id"), F.concat("l_returnflag", "l_linestatus").alias("metric_id"), "l_quantity").repartition(parts, "run_id")
    lines = own.groupBy("run_id", "metric_id").agg(F.sum("l_quantity").alias("quantity"))
    return lines.select("run_id", "metric_id", (F.col("quantity") / F.sum("quantity").over(Window.partitionBy("run_id"))).alias("weight"))


SELECTIONS_SQL = """selections AS (
    SELECT run_id, metric_id, quantity / sum(quantity) OVER (PARTITION BY run_id) AS weight
    FROM (SELECT l_orderkey AS run_id, l_returnflag || l_linestatus AS metric_id, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, point_id, x, y, y_true, y_pred, label): the first two components; the partition is the quadrant, with noise."""
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    quadrant = F.when(F.col("vec_id") % 20 == 0, -1).otherwise((x >= 0).cast("int") * 2 + (y >= 0).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 4).alias("dataset_id"), F.col("vec_id").alias("point_id"), x.alias("x"), y.alias("y"), F.col("label").alias("y_true"), quadrant.alias("y_pred"), quadrant.alias("label")
    )


POINTS_SQL = """points AS (
    SELECT vec_id % 4 AS dataset_id, vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS y_true,
        CASE WHEN vec_id % 20 = 0 THEN -1 ELSE CAST(embedding[1] >= 0 AS INTEGER) * 2 + CAST(embedding[2] >= 0 AS INTEGER) END AS y_pred,
        CASE WHEN vec_id % 20 = 0 THEN -1 ELSE CAST(embedding[1] >= 0 AS INTEGER) * 2 + CAST(embedding[2] >= 0 AS INTEGER) END AS label
    FROM embeddings)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the SQL beside a query does."""
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
