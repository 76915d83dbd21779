"""Queries of cleaning rules, parsers, checks, folds and choices, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nullsafe
from ..operators import models, neighbours, search, splits, summaries, utility
from ..sources import clouds
from .projections import RUNS_SQL, TRIALS_SQL, rounded, runs, table, trial_metrics
from .trial_queries import SCORED_SQL, _scored

KEY = ["dataset_id"]


def _texts(s, d):
    """Cells as text, some of them broken, and doubles with infinities and NaN."""
    k = F.col("c_custkey")
    text = F.when(k % 7 == 0, "nan").when(k % 7 == 1, " TRUE ").when(k % 7 == 2, "1").when(k % 7 == 3, "x1").otherwise(F.col("c_acctbal").cast("string"))
    value = F.when(k % 11 == 0, float("inf")).when(k % 11 == 1, float("-inf")).when(k % 11 == 2, float("nan")).when(k % 11 == 3, None).otherwise(F.col("c_acctbal") / 5000)
    return table(s, d, "customer").select("c_custkey", text.alias("text"), value.alias("v"), F.concat(F.when(k % 2 == 0, "utility__").otherwise("u__"), k.cast("string")).alias("name"))


TEXTS_SQL = """texts AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'nan' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'x1' ELSE CAST(c_acctbal AS VARCHAR) END AS text,
    CASE c_custkey % 11 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN NULL ELSE c_acctbal / 5000 END AS v, CASE WHEN c_custkey % 2 = 0 THEN 'utility__' ELSE 'u__' END || c_custkey AS name FROM customer)"""


def _open_slots(s, d):
    """Configurations of the whole space that a supplier's trials have not reached."""
    done = trial_metrics(s, d).groupBy("dataset_id").agg(F.max("candidate").alias("done"))
    return done.join(F.broadcast(search.candidate_table(s, search.enumerate_space()))).filter("candidate > done")


def _cells(s, d):
    k = F.col("n_nationkey")
    weights = F.concat(F.lit('{"a": '), (k / 10).cast("string"), F.lit(', "b": 2}'))
    names = F.when(k % 2 == 0, F.concat(F.lit("a; "), "n_name")).otherwise(F.concat(F.lit('["a", "'), "n_name", F.lit('"]')))
    return table(s, d, "nation").select("n_nationkey", clouds.parse_weights(weights).alias("w"), clouds.parse_names(names).alias("n"))


def _masked(s, d):
    """Candidates with a map of values, of which tax is not observed for every third and price missing for every fifth."""
    at = F.col("candidate")
    wide = trial_metrics(s, d).filter("metric_id in ('m_price', 'm_tax')").filter("not (metric_id = 'm_price' and candidate % 5 = 0)")
    maps = wide.groupBy("dataset_id", "candidate").agg(F.map_from_entries(F.collect_list(F.struct("metric_id", "score"))).alias("norm"))
    seen = maps.withColumn("observed", F.when(at % 3 == 0, F.array(F.lit("m_price"))).otherwise(F.array(F.lit("m_price"), F.lit("m_tax"))))
    return models.masked_features(seen, ["m_price", "m_tax"]).drop("norm", "observed")


def _policies(s, d):
    own = runs(s, d).filter("ari is not null").select("dataset_id", "view_id", F.col("method_name").alias("policy"), F.round("ari", 6).alias("ari"))
    return models.policy_targets(own, ["dataset_id", "view_id"])


def _embedded(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    other = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(s, d, "embeddings").filter("embedding is not null").select("vec_id", utility.cosine(v, other).alias("cosine"))


def _fold_rows(s, d):
    return trial_metrics(s, d).groupBy(F.col("metric_id").alias("config"), (F.col("dataset_id") % 4).alias("fold")).agg(F.round(F.avg("score"), 6).alias("score"), F.ascii(F.substr("metric_id", F.lit(3), F.lit(1))).alias("n_neighbors"))


QUERIES = {
    "clean_cells": lambda s, d: rounded(_texts(s, d).select("c_custkey", nullsafe.number("text").alias("number"), nullsafe.truthy("text").alias("truth"), nullsafe.finite("v").alias("finite"), nullsafe.clean_target(F.col("v")).alias("target"), nullsafe.clean_utility(F.col("v")).alias("utility"), nullsafe.safe_div(F.lit(1.0), F.col("v")).alias("inverse"), nullsafe.strip_prefix(F.col("name")).alias("bare"))),
    "parsed_cells": lambda s, d: rounded(_cells(s, d).select("n_nationkey", F.element_at("w", "a").alias("a"), F.element_at("w", "b").alias("b"), F.array_join("n", "|").alias("names"))),
    "crosstab": lambda s, d: summaries.crosstab(runs(s, d), "view_id", "status"),
    "masked_features": lambda s, d: rounded(_masked(s, d), 7),
    "select_policy": lambda s, d: models.select_policy(_policies(s, d), ["dataset_id", "view_id"], "regret").select("dataset_id", "view_id", "policy"),
    "select_policy_centered": lambda s, d: models.select_policy(_policies(s, d), ["dataset_id", "view_id"], "centered").select("dataset_id", "view_id", "policy"),
    "recovery": lambda s, d: rounded(models.recovery(_scored(s, d).groupBy("dataset_id").agg(F.max("ari").alias("oracle"), F.min("ari").alias("original"), F.max_by("ari", F.struct("objective", F.col("candidate"))).alias("reranked")))),
    "cosine_rows": lambda s, d: rounded(_embedded(s, d), 5),
    "one_se_rule": lambda s, d: rounded(neighbours.one_se_rule(_fold_rows(s, d)).select("config", "n_neighbors", "mean", "se")),
    "merged_tables": lambda s, d: clouds.merge_tables([table(s, d, t).select(F.col(k).cast("long").alias("key"), F.col(n).alias("name")) for t, k, n in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))]),
    "pending_work": lambda s, d: clouds.pending(table(s, d, "supplier").select("s_suppkey"), table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "COMPLETE").otherwise("FAILED").alias("state")), ["s_suppkey"]),
    "search_space": lambda s, d: _open_slots(s, d).groupBy("dataset_id", "algorithm").agg(F.count("*").alias("n"), F.min("candidate").alias("first")),
    "best_per_algorithm": lambda s, d: rounded(search.best_per_algorithm(_log(s, d))),
    "label_free_log": lambda s, d: clouds.assert_label_free(trial_metrics(s, d).select("dataset_id", "candidate", "metric_id", "score")).groupBy("metric_id").agg(F.count("*").alias("n")),
    "policies": lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").alias("dataset_id")).join(F.broadcast(s.createDataFrame(splits.policies(), "source string, size string, weighting string"))),
}


def _log(s, d):
    """A trial log in the search's shape: five algorithms in turn."""
    named = F.concat(F.lit("a"), (F.col("candidate") % 5).cast("string"))
    return trial_metrics(s, d).select("dataset_id", "candidate", named.alias("algorithm"), F.lit("{}").alias("config"), "valid", F.lit(2).alias("n_clusters"), F.least(F.lit(1.0), "score").alias("norm"))


_R = "round({0}, 6)".format
FINITE = "CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END"
POLICIES_SQL = RUNS_SQL + """,
targets AS (SELECT dataset_id, view_id, method_name AS policy, round(ari, 6) AS ari, max(round(ari, 6)) OVER w - round(ari, 6) AS regret, round(ari, 6) - avg(round(ari, 6)) OVER w AS centered FROM runs WHERE ari IS NOT NULL WINDOW w AS (PARTITION BY dataset_id, view_id))"""

ORACLE_SQL = {
    "clean_cells": f"""WITH {TEXTS_SQL} SELECT c_custkey, round(CASE WHEN isnan(TRY_CAST(text AS DOUBLE)) THEN NULL ELSE TRY_CAST(text AS DOUBLE) END, 6) AS number, lower(trim(text)) IN ('true', '1') AS truth, round({FINITE}, 6) AS finite,
        round(greatest(0.0, least(1.0, coalesce({FINITE}, 0.0))), 6) AS target, round(CASE WHEN v IS NULL OR isnan(v) THEN 0.0 ELSE greatest(0.0, least(1.0, v)) END, 6) AS utility,
        round(CASE WHEN abs({FINITE}) >= 1e-12 THEN 1.0 / v END, 6) AS inverse, CASE WHEN starts_with(name, 'utility__') THEN substr(name, 10) ELSE name END AS bare FROM texts""",
    "parsed_cells": "SELECT n_nationkey, round(n_nationkey / 10.0, 6) AS a, 2.0 AS b, 'a|' || n_name AS names FROM nation",
    "crosstab": f"WITH {RUNS_SQL} SELECT view_id, status, count(*) AS n FROM runs GROUP BY 1, 2",
    "masked_features": f"""WITH {TRIALS_SQL}, w AS (SELECT dataset_id, candidate, max(score) FILTER (metric_id = 'm_price' AND candidate % 5 <> 0) AS p, max(score) FILTER (metric_id = 'm_tax') AS t FROM trials GROUP BY 1, 2)
        SELECT dataset_id, candidate, round(coalesce(p, 0.0), 7) AS value__m_price, 1.0 AS observed__m_price, CAST(p IS NOT NULL AS DOUBLE) AS valid__m_price, round(CASE WHEN candidate % 3 = 0 THEN 0.0 ELSE t END, 7) AS value__m_tax, CAST(candidate % 3 <> 0 AS DOUBLE) AS observed__m_tax, CAST(candidate % 3 <> 0 AS DOUBLE) AS valid__m_tax FROM w""",
    "select_policy": f"WITH {POLICIES_SQL} SELECT dataset_id, view_id, policy FROM targets QUALIFY row_number() OVER (PARTITION BY dataset_id, view_id ORDER BY regret, policy) = 1",
    "select_policy_centered": f"WITH {POLICIES_SQL} SELECT dataset_id, view_id, policy FROM targets QUALIFY row_number() OVER (PARTITION BY dataset_id, view_id ORDER BY centered DESC, policy) = 1",
    "recovery": f"WITH {SCORED_SQL}, b AS (SELECT dataset_id, max(ari) AS oracle, min(ari) AS original, arg_max(ari, (objective, candidate)) AS reranked FROM scored GROUP BY 1) SELECT dataset_id, {_R('oracle')} AS oracle, {_R('original')} AS original, {_R('reranked')} AS reranked, CASE WHEN abs(oracle - original) > 1e-9 THEN {_R('(reranked - original) / (oracle - original)')} END AS recovery FROM b",
    "cosine_rows": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * abs(CAST(x AS DOUBLE)))) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS cosine FROM embeddings WHERE embedding IS NOT NULL",
    "one_se_rule": f"""WITH {TRIALS_SQL}, f AS (SELECT metric_id AS config, dataset_id % 4 AS fold, round(avg(score), 6) AS score, ascii(substr(metric_id, 3, 1)) AS n FROM trials GROUP BY 1, 2), c AS (SELECT config, n, avg(score) AS mean, stddev_samp(score) / sqrt(count(*)) AS se FROM f GROUP BY 1, 2)
        SELECT config, n AS n_neighbors, {_R('mean')} AS mean, {_R('se')} AS se FROM c WHERE mean >= (SELECT mean - coalesce(se, 0) FROM c ORDER BY mean DESC LIMIT 1) ORDER BY n, mean DESC, config LIMIT 1""",
    "merged_tables": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region",
    "pending_work": "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0",
    "best_per_algorithm": f"""WITH {TRIALS_SQL}, s AS (SELECT dataset_id, 'a' || (candidate % 5) AS algorithm, candidate, round(avg(least(1.0, score)), 9) AS objective FROM trials WHERE valid GROUP BY 1, 2, 3)
        SELECT dataset_id, algorithm, candidate, {_R('objective')} AS objective FROM s QUALIFY row_number() OVER (PARTITION BY dataset_id, algorithm ORDER BY objective DESC, candidate) = 1""",
    "label_free_log": f"WITH {TRIALS_SQL} SELECT metric_id, count(*) AS n FROM trials GROUP BY 1",
    "policies": "SELECT s_suppkey AS dataset_id, a AS source, b AS size, c AS weighting FROM supplier, (SELECT unnest(['mlp', 'knn']) AS a), (SELECT unnest(['1', '3', '5', '10', 'dynamic']) AS b), (SELECT unnest(['raw', 'softmax']) AS c)",
    "search_space": "WITH space(candidate, algorithm) AS (VALUES " + ", ".join(f"({c}, '{a}')" for c, a, _ in search.enumerate_space()) + """), done AS (SELECT l_suppkey AS dataset_id, least(32, count(*)) AS n FROM lineitem GROUP BY 1)
SELECT dataset_id, algorithm, count(*) AS n, CAST(min(candidate) AS INTEGER) AS first FROM done, space WHERE candidate > done.n GROUP BY 1, 2""",
}
