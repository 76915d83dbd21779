"""Queries over trial logs and utilities with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, utility
from .projections import TRIALS_SQL, UTILITIES_SQL, rounded, trial_metrics, utilities

KEY = ["dataset_id"]
BY = ["dataset_id", "metric_id"]


def _scored(s, d):
    """Candidates with an objective: the equally weighted normalised metrics, clipped to [0, 1]."""
    log = trial_metrics(s, d).withColumns({"norm": F.least(F.lit(1.0), F.col("score")), "weight": F.lit(0.25)})
    return ranking.aggregate_offline(log, ["dataset_id", "candidate", "ari", "valid"]).withColumn("objective", F.round("objective", 9))


def _ranked(s, d):
    return trial_metrics(s, d).select(*BY, "candidate", F.round("score", 9).alias("score"), F.round("ari", 9).alias("relevance"))


SCORED_SQL = TRIALS_SQL + """,
scored AS (SELECT dataset_id, candidate, ari, valid, round(sum(0.25 * least(1.0, score)), 9) AS objective FROM trials GROUP BY 1, 2, 3, 4)"""
RANKED_SQL = TRIALS_SQL + """,
long AS (SELECT dataset_id, metric_id, candidate, round(score, 9) AS score, round(ari, 9) AS relevance FROM trials),
placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, metric_id ORDER BY score DESC, candidate) AS s, row_number() OVER (PARTITION BY dataset_id, metric_id ORDER BY relevance DESC, candidate) AS r,
    row_number() OVER (PARTITION BY dataset_id, metric_id ORDER BY score, candidate) AS sb, row_number() OVER (PARTITION BY dataset_id, metric_id ORDER BY relevance, candidate) AS rb,
    rank() OVER (PARTITION BY dataset_id, metric_id ORDER BY score) + (count(*) OVER (PARTITION BY dataset_id, metric_id, score) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY dataset_id, metric_id ORDER BY relevance) + (count(*) OVER (PARTITION BY dataset_id, metric_id, relevance) - 1) / 2.0 AS y FROM long)"""
GAIN = "sum((power(2.0, relevance) - 1) / log2({0} + 1))"
GAIN_K = "sum(CASE WHEN {0} <= {1} THEN (power(2.0, relevance) - 1) / log2({0} + 1) ELSE 0 END)"
PAIRS_SQL = RANKED_SQL + """,
signs AS (SELECT dataset_id, metric_id, sign(a.score - b.score) AS dx, sign(a.relevance - b.relevance) AS dy FROM long a JOIN long b USING (dataset_id, metric_id) WHERE a.candidate < b.candidate),
pair AS (SELECT dataset_id, metric_id, CASE WHEN count(*) FILTER (dx <> 0) > 0 AND count(*) FILTER (dy <> 0) > 0 THEN sum(dx * dy) / sqrt(CAST(count(*) FILTER (dx <> 0) AS DOUBLE) * count(*) FILTER (dy <> 0)) END AS kendall,
    coalesce(avg(CASE WHEN dx * dy > 0 THEN 1.0 WHEN dx * dy = 0 THEN 0.5 ELSE 0.0 END) FILTER (dy <> 0), 0) AS pairwise FROM signs GROUP BY 1, 2)"""
RHO = "CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END"
DYNAMIC_SQL = UTILITIES_SQL + """,
near AS (SELECT dataset_id, metric_id, utility, greatest(0.0, least(1.0, utility)) AS u FROM utilities),
rel AS (SELECT dataset_id, count(*) FILTER (u >= 0.92 * top) AS k_rel FROM (SELECT *, max(u) OVER (PARTITION BY dataset_id) AS top FROM near) GROUP BY 1),
sizes AS (SELECT dataset_id, k_rel, CAST(greatest(1, least(10, CASE WHEN k_rel <= 5 THEN k_rel ELSE ceil((k_rel + 5) / 2.0) END)) AS INTEGER) AS k FROM rel)"""
CURVE_SQL = UTILITIES_SQL + """,
curves AS (SELECT dataset_id, metric_id, row_number() OVER o AS position, utility AS value, utility - lead(utility) OVER o AS gap,
    sum(p) OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id ROWS UNBOUNDED PRECEDING) AS mass,
    sum(CASE WHEN p > 0 THEN -p * ln(p) END) OVER (PARTITION BY dataset_id) AS entropy, 1.0 / sum(p * p) OVER (PARTITION BY dataset_id) AS participation
    FROM (SELECT *, utility / sum(utility) OVER (PARTITION BY dataset_id) AS p FROM utilities) WINDOW o AS (PARTITION BY dataset_id ORDER BY utility DESC, metric_id))"""
UTILITY_SQL = PAIRS_SQL + f""",
one AS (SELECT dataset_id, metric_id, count(*) AS n, greatest(0.0, coalesce({RHO}, 0)) AS spearman, {GAIN.format('s')} AS g, {GAIN.format('r')} AS gi,
    count(*) FILTER (s <= 7 AND r <= 7) / 7.0 AS overlap_top, count(*) FILTER (sb <= 7 AND rb <= 7) / 7.0 AS overlap_bottom,
    {GAIN_K.format('s', 5)} AS g5, {GAIN_K.format('r', 5)} AS g5i, {GAIN_K.format('s', 10)} AS g10, {GAIN_K.format('r', 10)} AS g10i FROM placed GROUP BY 1, 2)"""

QUERIES = {
    "topk_select": lambda s, d: rounded(ranking.top_k(utilities(s, d), 2, KEY)),
    "dynamic_k": lambda s, d: ranking.dynamic_k(utilities(s, d), KEY),
    "dynamic_selection": lambda s, d: ranking.select_dynamic(utilities(s, d), KEY).select("dataset_id", "metric_id", "k", "position"),
    "softmax_weights": lambda s, d: rounded(ranking.softmax_weights(ranking.top_k(utilities(s, d), 3, KEY), KEY).select(*BY, "weight")),
    "positive_weights": lambda s, d: rounded(ranking.positive_weights(ranking.top_k(utilities(s, d), 3, KEY), KEY).select(*BY, "weight")),
    "objective_j": lambda s, d: rounded(_scored(s, d)),
    "objective_online": lambda s, d: rounded(ranking.aggregate_online(trial_metrics(s, d).withColumns({"norm": F.when(F.col("metric_id") != "m_tax", F.col("score")), "weight": F.when(F.col("metric_id") != "m_price", 0.5)}), ["dataset_id", "candidate"])),
    "offline_argmax": lambda s, d: rounded(ranking.offline_argmax(_scored(s, d), KEY)),
    "valid_candidates": lambda s, d: rounded(ranking.offline_argmax(_scored(s, d).filter("valid"), KEY).select("dataset_id", "candidate", "regret")),
    "rerank_select": lambda s, d: ranking.select_reranked(_scored(s, d).withColumn("predicted_regret", 1 - F.col("objective")), KEY),
    "trace_gap": lambda s, d: rounded(ranking.trace_gap(_scored(s, d), KEY)),
    "warmstart_rank": lambda s, d: _scored(s, d).select("dataset_id", "candidate", F.row_number().over(_ari_order()).alias("position")),
    "competition_rank": lambda s, d: ranking.competition_rank(utilities(s, d), KEY, "utility").select(*BY, "rank"),
    "average_percentile": lambda s, d: rounded(ranking.average_percentile(utilities(s, d), KEY, "utility").select(*BY, "percentile")),
    "tie_groups": lambda s, d: ranking.tie_groups(_scored(s, d), KEY, "ari", "candidate").select("dataset_id", "candidate", "tie_group", "group_size", "is_best"),
    "utility_curve": lambda s, d: rounded(ranking.curve(utilities(s, d), KEY)),
    "k_rules": lambda s, d: ranking.k_rules(ranking.curve(utilities(s, d), KEY), KEY).select("dataset_id", "rel_80", "rel_92", "mass_50", "mass_90", "elbow"),
    "ndcg_full": lambda s, d: rounded(utility.ndcg(_ranked(s, d), BY)),
    "ndcg_at_10_linear": lambda s, d: rounded(utility.ndcg(_ranked(s, d), BY, k=10, exponential=False)),
    "topk_overlap": lambda s, d: rounded(utility.overlap(_ranked(s, d), BY, 7)),
    "bottomk_overlap": lambda s, d: rounded(utility.overlap(_ranked(s, d), BY, 7, ascending=True)),
    "spearman_avg_rank": lambda s, d: rounded(utility.spearman(_ranked(s, d), BY)),
    "pairwise_accuracy": lambda s, d: rounded(utility.pair_scores(_ranked(s, d), BY)),
    "utility_score": lambda s, d: rounded(utility.utility_score(_ranked(s, d), BY).select(*BY, "n", "spearman", "kendall", "pairwise", "ndcg", "utility")),
    "cvi_star": lambda s, d: _cvi_star(s, d),
    "regression_errors": lambda s, d: rounded(utility.regression_errors(trial_metrics(s, d).select("metric_id", F.col("ari").alias("truth"), F.col("score").alias("predicted")), ["metric_id"])),
    "top_set_jaccard": lambda s, d: rounded(utility.top_set_similarity(utilities(s, d).withColumn("g", F.col("dataset_id") % 10).groupBy("g", "metric_id").agg(F.round(F.avg("utility"), 6).alias("utility")), "g", 2)),
}


def _ari_order():
    from pyspark.sql import Window

    return Window.partitionBy("dataset_id").orderBy(F.desc_nulls_last("ari"), "candidate")


def _cvi_star(s, d):
    """The index with the highest rank correlation with ARI, ties by name (ST-26)."""
    rho = utility.spearman(_ranked(s, d), BY).withColumn("spearman", F.round("spearman", 6))
    return rho.groupBy("dataset_id").agg(F.max_by("metric_id", F.struct(F.coalesce("spearman", F.lit(-2.0)), -F.ascii(F.substr("metric_id", F.lit(3))))).alias("metric_id"), F.max("spearman").alias("spearman"))


ORACLE_SQL = {
    "topk_select": f"WITH {UTILITIES_SQL} SELECT dataset_id, metric_id, utility, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS INTEGER) AS position FROM utilities QUALIFY position <= 2",
    "dynamic_k": f"WITH {DYNAMIC_SQL} SELECT dataset_id, k_rel, k FROM sizes",
    "dynamic_selection": f"WITH {DYNAMIC_SQL} SELECT dataset_id, metric_id, k, position FROM (SELECT dataset_id, metric_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS INTEGER) AS position FROM utilities) JOIN sizes USING (dataset_id) WHERE position <= k",
    "softmax_weights": f"WITH {UTILITIES_SQL}, sel AS (SELECT *, max(utility) OVER (PARTITION BY dataset_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS rn FROM utilities) WHERE rn <= 3) SELECT dataset_id, metric_id, round(exp((utility - top) / 0.1) / sum(exp((utility - top) / 0.1)) OVER (PARTITION BY dataset_id), 6) AS weight FROM sel",
    "positive_weights": f"WITH {UTILITIES_SQL}, sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS rn FROM utilities) WHERE rn <= 3) SELECT dataset_id, metric_id, round(greatest(utility, 0) / sum(greatest(utility, 0)) OVER (PARTITION BY dataset_id), 6) AS weight FROM sel",
    "objective_j": f"WITH {SCORED_SQL} SELECT dataset_id, candidate, round(ari, 6) AS ari, valid, round(objective, 6) AS objective FROM scored",
    "objective_online": f"WITH {TRIALS_SQL} SELECT dataset_id, candidate, round(sum(CASE WHEN metric_id = 'm_price' THEN 1.0 ELSE 0.5 END * CASE WHEN metric_id = 'm_tax' THEN 0 ELSE score END) / sum(CASE WHEN metric_id = 'm_price' THEN 1.0 ELSE 0.5 END), 6) AS objective FROM trials GROUP BY 1, 2",
    "offline_argmax": f"""WITH {SCORED_SQL}, t AS (SELECT *, max(objective) OVER (PARTITION BY dataset_id) AS top, max(ari) OVER (PARTITION BY dataset_id) AS ceiling FROM scored)
        SELECT dataset_id, min(candidate) AS candidate, round(arg_min(ari, candidate), 6) AS ari, round(arg_min(objective, candidate), 6) AS objective, round(max(ceiling), 6) AS ceiling, count(*) AS n_tied, round(max(ceiling) - arg_min(ari, candidate), 6) AS regret FROM t WHERE objective >= top - 1e-12 GROUP BY 1""",
    "valid_candidates": f"""WITH {SCORED_SQL}, t AS (SELECT *, max(objective) OVER (PARTITION BY dataset_id) AS top, max(ari) OVER (PARTITION BY dataset_id) AS ceiling FROM scored WHERE valid)
        SELECT dataset_id, min(candidate) AS candidate, round(max(ceiling) - arg_min(ari, candidate), 6) AS regret FROM t WHERE objective >= top - 1e-12 GROUP BY 1""",
    "rerank_select": f"WITH {SCORED_SQL}, t AS (SELECT *, min(1 - objective) OVER (PARTITION BY dataset_id) AS low FROM scored WHERE valid) SELECT dataset_id, min(candidate) AS candidate FROM t WHERE 1 - objective <= low + 1e-12 GROUP BY 1",
    "trace_gap": f"""WITH {SCORED_SQL}, t AS (SELECT *, rank() OVER (PARTITION BY dataset_id ORDER BY ari DESC) AS ra, rank() OVER (PARTITION BY dataset_id ORDER BY objective DESC NULLS LAST) AS ro,
            row_number() OVER (PARTITION BY dataset_id ORDER BY objective DESC NULLS LAST, candidate) AS cn, row_number() OVER (PARTITION BY dataset_id ORDER BY ari DESC, candidate) AS bn FROM scored),
        u AS (SELECT dataset_id, max(ari) FILTER (cn = 1) AS selected_ari, max(ari) FILTER (bn = 1) AS best_ari, CAST(max(ra) FILTER (cn = 1) AS INTEGER) AS rank_of_selected, CAST(max(ro) FILTER (bn = 1) AS INTEGER) AS rank_of_best FROM t GROUP BY 1)
        SELECT dataset_id, round(selected_ari, 6) AS selected_ari, round(best_ari, 6) AS best_ari, round(best_ari - selected_ari, 6) AS gap, CASE WHEN abs(best_ari) > 1e-12 THEN round((best_ari - selected_ari) / best_ari, 6) END AS relative_gap, rank_of_selected, rank_of_best FROM u""",
    "warmstart_rank": f"WITH {SCORED_SQL} SELECT dataset_id, candidate, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY ari DESC NULLS LAST, candidate) AS INTEGER) AS position FROM scored",
    "competition_rank": f"WITH {UTILITIES_SQL} SELECT dataset_id, metric_id, CAST(rank() OVER (PARTITION BY dataset_id ORDER BY utility DESC) AS INTEGER) AS rank FROM utilities",
    "average_percentile": f"WITH {UTILITIES_SQL} SELECT dataset_id, metric_id, round((rank() OVER (PARTITION BY dataset_id ORDER BY utility) + (count(*) OVER (PARTITION BY dataset_id, utility) - 1) / 2.0) / count(*) OVER (PARTITION BY dataset_id), 6) AS percentile FROM utilities",
    "tie_groups": f"""WITH {SCORED_SQL}, g AS (SELECT dataset_id, candidate, ari, lag(ari) OVER (PARTITION BY dataset_id ORDER BY ari DESC, candidate) - ari AS gap FROM scored),
        t AS (SELECT dataset_id, candidate, CAST(sum(CASE WHEN gap > 1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id ORDER BY ari DESC, candidate) AS BIGINT) AS tie_group FROM g)
        SELECT dataset_id, candidate, tie_group, count(*) OVER (PARTITION BY dataset_id, tie_group) AS group_size, tie_group = 0 AS is_best FROM t""",
    "utility_curve": f"WITH {CURVE_SQL} SELECT dataset_id, metric_id, CAST(position AS INTEGER) AS position, round(value, 6) AS value, round(gap, 6) AS gap, round(mass, 6) AS mass, round(entropy, 6) AS entropy, round(participation, 6) AS participation FROM curves",
    "k_rules": f"""WITH {CURVE_SQL}, t AS (SELECT *, max(value) OVER (PARTITION BY dataset_id) AS top, row_number() OVER (PARTITION BY dataset_id ORDER BY gap DESC NULLS LAST, position) AS gn FROM curves)
        SELECT dataset_id, count(*) FILTER (value >= 0.8 * top) AS rel_80, count(*) FILTER (value >= 0.92 * top) AS rel_92, CAST(min(position) FILTER (mass >= 0.5 - 1e-12) AS INTEGER) AS mass_50, CAST(min(position) FILTER (mass >= 0.9 - 1e-12) AS INTEGER) AS mass_90, CAST(max(position) FILTER (gn = 1 AND gap IS NOT NULL) AS INTEGER) AS elbow FROM t GROUP BY 1""",
    "ndcg_full": f"WITH {RANKED_SQL} SELECT dataset_id, metric_id, CASE WHEN {GAIN.format('r')} > 0 THEN round({GAIN.format('s')} / {GAIN.format('r')}, 6) ELSE 0.0 END AS ndcg FROM placed GROUP BY 1, 2",
    "ndcg_at_10_linear": f"WITH {RANKED_SQL} SELECT dataset_id, metric_id, CASE WHEN sum(relevance) FILTER (r <= 10) > 0 THEN round(sum(relevance / log2(s + 1)) FILTER (s <= 10) / sum(relevance / log2(r + 1)) FILTER (r <= 10), 6) ELSE 0.0 END AS ndcg FROM placed GROUP BY 1, 2",
    "topk_overlap": f"WITH {RANKED_SQL} SELECT dataset_id, metric_id, round(count(*) FILTER (s <= 7 AND r <= 7) / CAST(least(7, count(*)) AS DOUBLE), 6) AS overlap FROM placed GROUP BY 1, 2",
    "bottomk_overlap": f"WITH {RANKED_SQL} SELECT dataset_id, metric_id, round(count(*) FILTER (sb <= 7 AND rb <= 7) / CAST(least(7, count(*)) AS DOUBLE), 6) AS overlap FROM placed GROUP BY 1, 2",
    "spearman_avg_rank": f"WITH {RANKED_SQL} SELECT dataset_id, metric_id, round({RHO}, 6) AS spearman FROM placed GROUP BY 1, 2",
    "pairwise_accuracy": f"WITH {PAIRS_SQL} SELECT dataset_id, metric_id, round(kendall, 6) AS kendall, round(pairwise, 6) AS pairwise FROM pair",
    "utility_score": f"""WITH {UTILITY_SQL} SELECT dataset_id, metric_id, n, round(spearman, 6) AS spearman, round(greatest(0.0, coalesce(kendall, 0)), 6) AS kendall, round(pairwise, 6) AS pairwise, round(CASE WHEN gi > 0 THEN g / gi ELSE 0 END, 6) AS ndcg,
        round(greatest(0.0, least(1.0, 0.18 * spearman + 0.12 * greatest(0.0, coalesce(kendall, 0)) + 0.20 * pairwise + 0.20 * CASE WHEN gi > 0 THEN g / gi ELSE 0 END + 0.05 * overlap_top + 0.05 * overlap_bottom + 0.10 * CASE WHEN g5i > 0 THEN g5 / g5i ELSE 0 END + 0.10 * CASE WHEN g10i > 0 THEN g10 / g10i ELSE 0 END)), 6) AS utility FROM one JOIN pair USING (dataset_id, metric_id)""",
    "cvi_star": f"""WITH {RANKED_SQL}, rho AS (SELECT dataset_id, metric_id, round({RHO}, 6) AS spearman FROM placed GROUP BY 1, 2)
        SELECT dataset_id, metric_id, spearman FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY spearman DESC NULLS LAST, metric_id) AS rn FROM rho) WHERE rn = 1""",
    "regression_errors": f"WITH {TRIALS_SQL} SELECT metric_id, count(*) AS n, round(avg((score - ari) ** 2), 6) AS mse, round(sqrt(avg((score - ari) ** 2)), 6) AS rmse, round(avg(abs(score - ari)), 6) AS mae, round(1 - sum((score - ari) ** 2) / (var_pop(ari) * count(*)), 6) AS r2 FROM trials GROUP BY 1",
    "top_set_jaccard": f"""WITH {UTILITIES_SQL}, g AS (SELECT dataset_id % 10 AS g, metric_id, round(avg(utility), 6) AS utility FROM utilities GROUP BY 1, 2),
        top AS (SELECT g, metric_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY utility DESC, metric_id) AS rn FROM g) WHERE rn <= 2)
        SELECT a.g AS a, b.g AS b, round(count(*) FILTER (a.metric_id = b.metric_id) / CAST(4 - count(*) FILTER (a.metric_id = b.metric_id) AS DOUBLE), 6) AS jaccard FROM top a JOIN top b ON a.g < b.g GROUP BY 1, 2""",
}
