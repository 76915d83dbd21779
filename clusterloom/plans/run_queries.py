"""Queries over run frames with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, pairing, portfolio, resampling, statistics, summaries
from .projections import BEST_SQL, RUNS_SQL, SELECTIONS_SQL, rounded, runs, selections


def _best(spark, d):
    return frames.best_view_frame(runs(spark, d))


def _deltas(spark, d):
    return pairing.all_pairs(_best(spark, d))


R = "round({0}, 6)".format
BLOCK = ("method_name, count(*) AS n_datasets, count(best_ari) AS n_success, round(avg(best_ari), 6) AS best_ari_mean, round(median(best_ari), 6) AS best_ari_median, "
    "round(stddev_samp(best_ari), 6) AS best_ari_std, round(quantile_cont(best_ari, 0.25), 6) AS best_ari_q25, round(quantile_cont(best_ari, 0.75), 6) AS best_ari_q75, "
    "round(sum(total_runtime_sec), 6) AS total_runtime_sec, round(quantile_cont(best_runtime_sec, 0.9), 6) AS runtime_p90, "
    "round(avg(CAST(best_view = 'x_only' AS DOUBLE)), 6) AS x_only_share, bool_and(n_success = n_views) AS all_views_ok")
RUN_BLOCK = """count(*) AS n_runs, count(DISTINCT dataset_id) AS n_datasets, count(ari) AS n_success, count(*) FILTER (status = 'failed') AS n_failed,
    round(avg(CAST(ari IS NOT NULL AS DOUBLE)), 6) AS success_rate, round(avg(ari), 6) AS ari_mean, round(median(ari), 6) AS ari_median, round(stddev_samp(ari), 6) AS ari_std,
    round(quantile_cont(ari, 0.25), 6) AS ari_q25, round(quantile_cont(ari, 0.75), 6) AS ari_q75, round(min(ari), 6) AS ari_min, round(max(ari), 6) AS ari_max,
    round(avg(runtime_sec) FILTER (ari IS NOT NULL), 6) AS runtime_mean, round(median(runtime_sec) FILTER (ari IS NOT NULL), 6) AS runtime_median, round(quantile_cont(runtime_sec, 0.9) FILTER (ari IS NOT NULL), 6) AS runtime_p90,
    round(avg(CAST(selected_k = true_k AS DOUBLE)) FILTER (ari IS NOT NULL), 6) AS k_accuracy, round(avg(abs(selected_k - true_k)) FILTER (ari IS NOT NULL), 6) AS k_abs_error,
    round(avg(CAST(selected_k > true_k AS DOUBLE)) FILTER (ari IS NOT NULL), 6) AS k_over_rate, round(avg(CAST(selected_k < true_k AS DOUBLE)) FILTER (ari IS NOT NULL), 6) AS k_under_rate"""
PAIRS_SQL = BEST_SQL + """,
pairs AS (SELECT a.method_name AS method, b.method_name AS baseline, a.dataset_id, a.family, a.best_ari - b.best_ari AS delta
    FROM best a JOIN best b USING (dataset_id) WHERE a.method_name <> b.method_name AND a.best_ari IS NOT NULL AND b.best_ari IS NOT NULL)"""
WIN_BLOCK = """count(*) AS n_pairs, count(*) FILTER (delta > 1e-6) AS wins, count(*) FILTER (abs(delta) <= 1e-6) AS ties, count(*) FILTER (delta < -1e-6) AS losses,
    round(avg(CAST(delta > 1e-6 AS DOUBLE)), 6) AS win_rate, round(avg(delta), 6) AS gain_mean, round(median(delta), 6) AS gain_median, round(quantile_cont(delta, 0.25), 6) AS gain_q25, round(quantile_cont(delta, 0.75), 6) AS gain_q75"""
VBS_SQL = BEST_SQL + """,
vbs AS (SELECT * FROM (SELECT dataset_id, method_name AS winner, best_ari AS vbs_ari, count(*) OVER w AS n_members, sum(total_runtime_sec) OVER w AS portfolio_runtime_sec,
        coalesce(sum(CAST(best_ari >= top - 1e-12 AS INTEGER)) OVER w, 0) AS n_tied,
        row_number() OVER (PARTITION BY dataset_id ORDER BY best_ari DESC NULLS LAST, view_median DESC NULLS LAST, view_mean DESC NULLS LAST, best_runtime_sec NULLS LAST, method_name) AS rn
    FROM (SELECT *, max(best_ari) OVER (PARTITION BY dataset_id) AS top FROM best) WINDOW w AS (PARTITION BY dataset_id)) WHERE rn = 1)"""
SIGNED_SQL = PAIRS_SQL + """,
sized AS (SELECT method, baseline, delta, rank() OVER (PARTITION BY method, baseline ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY method, baseline, abs(delta)) - 1) / 2.0 AS r FROM pairs WHERE delta <> 0)"""

QUERIES = {
    "best_view_summary": lambda s, d: rounded(summaries.summarize_methods(_best(s, d))),
    "best_view_frame": lambda s, d: rounded(_best(s, d).select("dataset_id", "method_name", "best_ari", "best_view", "best_runtime_sec", "total_runtime_sec", "n_views", "n_success", "view_mean", "view_median", "view_min")),
    "best_view_rows": lambda s, d: rounded(frames.best_view_rows(runs(s, d)).select("dataset_id", "method_name", "view_id", "ari")),
    "collapse_best_view": lambda s, d: rounded(frames.collapse_best_view(runs(s, d)).select("dataset_id", "method_name", "view_id", "status", "ari")),
    "dataset_level_rank": lambda s, d: rounded(frames.dataset_level_frame(_best(s, d)).select("dataset_id", "method_name", "rank_within_pool", "delta_to_best", "is_best")),
    "method_summary": lambda s, d: rounded(summaries.summarize_by(runs(s, d), ["method_name"])),
    "view_method_summary": lambda s, d: rounded(summaries.summarize_by(runs(s, d), ["view_id", "method_name"])),
    "family_summary": lambda s, d: rounded(summaries.summarize_by(runs(s, d), ["family"])),
    "method_grouping_sets": lambda s, d: rounded(summaries.standard_summaries(runs(s, d)).withColumns({"family": F.col("family").cast("double"), "true_k": F.col("true_k").cast("double")})),
    "k_accuracy": lambda s, d: rounded(summaries.k_accuracy(runs(s, d))),
    "k_confusion": lambda s, d: summaries.k_confusion(runs(s, d)),
    "coverage_audit": lambda s, d: summaries.coverage_audit(frames.complete_frame(runs(s, d))),
    "missing_runs_anti": lambda s, d: frames.missing_runs(runs(s, d)),
    "win_rates": lambda s, d: rounded(summaries.win_rates(_best(s, d))),
    "view_means": lambda s, d: rounded(summaries.view_means(runs(s, d))),
    "key_violations": lambda s, d: summaries.key_violations(runs(s, d), ["dataset_id", "method_name"]),
    "null_rates": lambda s, d: rounded(summaries.null_rates(runs(s, d), ["ari", "runtime_sec"])),
    "winrate_pairs": lambda s, d: rounded(pairing.winrates(_best(s, d))),
    "grouped_winrate": lambda s, d: rounded(pairing.winrates(_best(s, d), ["family"])),
    "paired_values": lambda s, d: rounded(pairing.paired_values(_best(s, d), "click", "error")),
    "paired_gap": lambda s, d: rounded(pairing.paired_gap(_best(s, d), "click", "error")),
    "view_gap": lambda s, d: rounded(pairing.view_gap(_best(s, d))),
    "pareto_frontier": lambda s, d: rounded(pairing.pareto_frontier(_rounded_summary(s, d), "runtime", "mean")),
    "dominated_by": lambda s, d: pairing.dominators(_rounded_summary(s, d), "method_name", "runtime", "mean").select("method_name", F.concat_ws(",", "dominated_by").alias("dominated_by")),
    "vbs_winner": lambda s, d: rounded(portfolio.virtual_best(_best(s, d))),
    "vbs_summary": lambda s, d: rounded(portfolio.vbs_summary(portfolio.virtual_best(_best(s, d)))),
    "winner_composition": lambda s, d: rounded(portfolio.winner_composition(portfolio.virtual_best(_best(s, d)))),
    "unique_coverage": lambda s, d: portfolio.unique_coverage(_best(s, d)),
    "headroom": lambda s, d: rounded(portfolio.headroom(_best(s, d))),
    "greedy_portfolio": lambda s, d: rounded(portfolio.greedy_portfolio(_best(s, d))),
    "min_portfolio_size": lambda s, d: portfolio.min_size_for_gain(portfolio.greedy_portfolio(_best(s, d))),
    "representative": lambda s, d: rounded(portfolio.representative(_best(s, d))),
    "family_representatives": lambda s, d: rounded(portfolio.representative(_best(s, d), ["family"])),
    "selection_stability": lambda s, d: portfolio.selection_stability(_best(s, d)),
    "random_subset_curve": lambda s, d: portfolio.random_subset_curve(_best(s, d)),
    "metric_usage": lambda s, d: rounded(summaries.metric_usage(selections(s, d))),
    "category_usage": lambda s, d: rounded(summaries.category_usage(selections(s, d), selections(s, d).select("metric_id", F.substr("metric_id", F.lit(1), F.lit(1)).alias("category")).distinct())),
    "top_metric_frequency": lambda s, d: summaries.top_metric_frequency(selections(s, d)),
    "weight_entropy": lambda s, d: rounded(summaries.weight_entropy(selections(s, d))),
    "signed_rank": lambda s, d: rounded(statistics.signed_ranks(_deltas(s, d), ["method", "baseline"])),
    "signed_rank_p": lambda s, d: rounded(statistics.signed_rank_p(_deltas(s, d), ["method", "baseline"])),
    "effect_sizes": lambda s, d: rounded(statistics.effect_sizes(_deltas(s, d), ["method", "baseline"])),
    "holm": lambda s, d: rounded(statistics.holm(_tests(s, d), ["method"])),
    "bh_fdr": lambda s, d: rounded(statistics.bh_fdr(_tests(s, d), ["method"])),
    "bootstrap_ci": lambda s, d: resampling.bootstrap(_best(s, d), ["method_name"], "best_ari", "dataset_id"),
    "group_permutation": lambda s, d: resampling.permutation(_best(s, d), "family", "best_ari"),
    "factorial_contrasts": lambda s, d: rounded(statistics.factorial_effects(runs(s, d).withColumns({"fa": (F.col("view_rank") > 0).cast("int"), "fb": (F.col("selected_k") > 3).cast("int")}), "method_name", "fa", "fb", "ari")),
}


def _rounded_summary(s, d):
    return rounded(summaries.summarize_by(runs(s, d), ["method_name"]).select("method_name", F.col("runtime_mean").alias("runtime"), F.col("ari_mean").alias("mean")))


def _tests(s, d):
    """Hypothesis table: a made-up but deterministic p per pair."""
    wins = pairing.winrates(_best(s, d))
    return wins.select("method", F.col("baseline").alias("hypothesis"), F.round(F.col("losses") / F.col("n_pairs"), 6).alias("p_value"))


TESTS_SQL = PAIRS_SQL + """,
tests AS (SELECT method, baseline AS hypothesis, round(count(*) FILTER (delta < -1e-6) / CAST(count(*) AS DOUBLE), 6) AS p_value FROM pairs GROUP BY 1, 2),
numbered AS (SELECT *, count(*) OVER (PARTITION BY method) AS m, row_number() OVER (PARTITION BY method ORDER BY p_value, hypothesis) AS rn FROM tests)"""
SUMMARY_SQL = RUNS_SQL + """,
per AS (SELECT method_name, round(avg(runtime_sec) FILTER (ari IS NOT NULL), 6) AS runtime, round(avg(ari), 6) AS mean FROM runs GROUP BY 1)"""

ORACLE_SQL = {
    "best_view_summary": f"WITH {BEST_SQL} SELECT {BLOCK} FROM best GROUP BY method_name",
    "best_view_frame": f"WITH {BEST_SQL} SELECT dataset_id, method_name, {R('best_ari')} AS best_ari, best_view, best_runtime_sec, total_runtime_sec, n_views, n_success, {R('view_mean')} AS view_mean, {R('view_median')} AS view_median, {R('view_min')} AS view_min FROM best",
    "best_view_rows": f"WITH {RUNS_SQL} SELECT dataset_id, method_name, view_id, {R('ari')} AS ari FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, method_name ORDER BY ari DESC, view_rank) AS rn FROM runs WHERE ari IS NOT NULL) WHERE rn = 1",
    "collapse_best_view": f"WITH {RUNS_SQL} SELECT dataset_id, method_name, view_id, status, {R('ari')} AS ari FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, method_name ORDER BY status <> 'success', ari DESC NULLS LAST, view_rank) AS rn FROM runs) WHERE rn = 1",
    "dataset_level_rank": f"WITH {BEST_SQL} SELECT dataset_id, method_name, CASE WHEN best_ari IS NOT NULL THEN CAST(rank() OVER (PARTITION BY dataset_id ORDER BY best_ari DESC NULLS LAST) AS INTEGER) END AS rank_within_pool, round(best_ari - max(best_ari) OVER (PARTITION BY dataset_id), 6) AS delta_to_best, coalesce(best_ari = max(best_ari) OVER (PARTITION BY dataset_id), false) AS is_best FROM best",
    "method_summary": f"WITH {RUNS_SQL} SELECT method_name, {RUN_BLOCK} FROM runs GROUP BY 1",
    "view_method_summary": f"WITH {RUNS_SQL} SELECT view_id, method_name, {RUN_BLOCK} FROM runs GROUP BY 1, 2",
    "family_summary": f"WITH {RUNS_SQL} SELECT family, {RUN_BLOCK} FROM runs GROUP BY 1",
    "method_grouping_sets": f"""WITH {RUNS_SQL} SELECT method_name, CAST(family AS DOUBLE) AS family, view_id, CAST(true_k AS DOUBLE) AS true_k,
        concat_ws('+', CASE WHEN grouping(family) = 0 THEN 'family' END, CASE WHEN grouping(view_id) = 0 THEN 'view_id' END, CASE WHEN grouping(true_k) = 0 THEN 'true_k' END) AS "grouping",
        count(*) AS n_runs, round(avg(ari), 6) AS ari_mean FROM runs GROUP BY GROUPING SETS ((method_name), (method_name, family), (method_name, view_id), (method_name, true_k))""",
    "k_accuracy": f"WITH {RUNS_SQL} SELECT method_name, count(*) AS n, round(avg(CAST(selected_k = true_k AS DOUBLE)), 6) AS k_accuracy, round(avg(abs(selected_k - true_k)), 6) AS k_mae, round(avg(selected_k - true_k), 6) AS k_bias, round(avg(CAST(selected_k > true_k AS DOUBLE)), 6) AS over_rate, round(avg(CAST(selected_k < true_k AS DOUBLE)), 6) AS under_rate FROM runs WHERE ari IS NOT NULL GROUP BY 1",
    "k_confusion": f"WITH {RUNS_SQL} SELECT method_name, true_k, selected_k, count(*) AS n FROM runs WHERE ari IS NOT NULL GROUP BY 1, 2, 3",
    "coverage_audit": f"""WITH {RUNS_SQL}, grid AS (SELECT * FROM (SELECT DISTINCT dataset_id FROM runs), (SELECT DISTINCT method_name FROM runs), (SELECT unnest(['x_only', 'y_only', 'xy_2d']) AS view_id)),
        full_ AS (SELECT dataset_id, method_name, view_id, coalesce(status, 'missing') AS status FROM grid LEFT JOIN runs USING (dataset_id, method_name, view_id))
        SELECT method_name, count(DISTINCT dataset_id) AS n_datasets, count(DISTINCT view_id) AS n_views, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'missing') AS n_missing, count(DISTINCT view_id) = 3 AS views_complete FROM full_ GROUP BY 1""",
    "missing_runs_anti": f"WITH {RUNS_SQL} SELECT * FROM (SELECT DISTINCT dataset_id FROM runs), (SELECT DISTINCT method_name FROM runs), (SELECT unnest(['x_only', 'y_only', 'xy_2d']) AS view_id) EXCEPT SELECT dataset_id, method_name, view_id FROM runs",
    "win_rates": f"""WITH {BEST_SQL}, won AS (SELECT dataset_id, method_name, best_ari >= max(best_ari) OVER (PARTITION BY dataset_id) - 1e-12 AS won FROM best WHERE best_ari IS NOT NULL),
        shared AS (SELECT *, CASE WHEN won THEN 1.0 / sum(CAST(won AS INTEGER)) OVER (PARTITION BY dataset_id) ELSE 0 END AS share FROM won)
        SELECT method_name, round(sum(share), 6) AS wins, count(DISTINCT dataset_id) AS n_datasets, round(avg(share), 6) AS win_rate FROM shared GROUP BY 1""",
    "view_means": f"WITH {RUNS_SQL} SELECT dataset_id, method_name, round(avg(ari), 6) AS value FROM runs WHERE ari IS NOT NULL GROUP BY 1, 2",
    "key_violations": f"WITH {RUNS_SQL} SELECT dataset_id, method_name, count(*) AS n FROM runs GROUP BY 1, 2 HAVING count(*) > 1",
    "null_rates": f"WITH {RUNS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, round(avg(CAST({c} IS NULL AS DOUBLE)), 6) AS null_rate, round(min({c}), 6) AS least, round(max({c}), 6) AS most FROM runs" for c in ("ari", "runtime_sec")),
    "winrate_pairs": f"WITH {PAIRS_SQL} SELECT method, baseline, {WIN_BLOCK} FROM pairs GROUP BY 1, 2",
    "grouped_winrate": f"WITH {PAIRS_SQL} SELECT family, method, baseline, {WIN_BLOCK} FROM pairs GROUP BY 1, 2, 3",
    "paired_values": f"WITH {BEST_SQL} SELECT dataset_id, {R('a.best_ari')} AS value_a, {R('b.best_ari')} AS value_b, {R('a.best_ari - b.best_ari')} AS delta FROM best a JOIN best b USING (dataset_id) WHERE a.method_name = 'click' AND b.method_name = 'error' AND a.best_ari IS NOT NULL AND b.best_ari IS NOT NULL",
    "paired_gap": f"WITH {PAIRS_SQL} SELECT count(*) AS n, {R('avg(delta)')} AS gap_mean, {R('median(delta)')} AS gap_median, {R('stddev_samp(delta)')} AS gap_std, {R('avg(CAST(delta > 0 AS DOUBLE))')} AS positive_share FROM pairs WHERE method = 'click' AND baseline = 'error'",
    "view_gap": f"WITH {BEST_SQL} SELECT method_name, count(*) AS n, {R('avg(best_ari - view_mean)')} AS gap_mean, {R('median(best_ari - view_mean)')} AS gap_median, {R('max(best_ari - view_mean)')} AS gap_max FROM best WHERE best_ari IS NOT NULL GROUP BY 1",
    "pareto_frontier": f"WITH {SUMMARY_SQL} SELECT method_name, runtime, mean FROM (SELECT *, max(mean) OVER (ORDER BY runtime, mean DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM per) WHERE before IS NULL OR mean > before + 1e-15",
    "dominated_by": f"WITH {SUMMARY_SQL} SELECT a.method_name, array_to_string(list_slice(list(b.method_name ORDER BY b.method_name), 1, 4), ',') AS dominated_by FROM per a JOIN per b ON b.runtime <= a.runtime AND b.mean >= a.mean AND a.method_name <> b.method_name GROUP BY 1",
    "vbs_winner": f"WITH {VBS_SQL} SELECT dataset_id, winner, {R('vbs_ari')} AS vbs_ari, n_members, portfolio_runtime_sec, n_tied, CASE WHEN vbs_ari IS NULL THEN 'none' WHEN n_tied > 1 THEN 'tie_break' ELSE 'ari' END AS reason FROM vbs",
    "vbs_summary": f"WITH {VBS_SQL} SELECT count(*) AS n_datasets, {R('avg(vbs_ari)')} AS vbs_mean, {R('median(vbs_ari)')} AS vbs_median, {R('sum(portfolio_runtime_sec)')} AS runtime_sec, {R('avg(CAST(vbs_ari IS NOT NULL AND n_tied > 1 AS DOUBLE))')} AS tie_rate FROM vbs",
    "winner_composition": f"WITH {VBS_SQL} SELECT winner, count(*) AS wins, {R('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share FROM vbs WHERE vbs_ari IS NOT NULL GROUP BY 1",
    "unique_coverage": f"""WITH {BEST_SQL}, tops AS (SELECT dataset_id, method_name, best_ari >= max(best_ari) OVER (PARTITION BY dataset_id) - 1e-12 AS at_top FROM best WHERE best_ari IS NOT NULL),
        alone AS (SELECT *, at_top AND sum(CAST(at_top AS INTEGER)) OVER (PARTITION BY dataset_id) = 1 AS alone FROM tops)
        SELECT method_name, count(*) FILTER (at_top) AS n_best, count(*) FILTER (alone) AS n_unique, count(*) AS n_datasets FROM alone GROUP BY 1""",
    "headroom": f"WITH {BEST_SQL}, gaps AS (SELECT method_name, max(best_ari) OVER (PARTITION BY dataset_id) - best_ari AS gap FROM best) SELECT method_name, count(*) AS n, {R('avg(gap)')} AS headroom_mean, {R('median(gap)')} AS headroom_median, {R('max(gap)')} AS headroom_max FROM gaps WHERE gap IS NOT NULL GROUP BY 1",
    "metric_usage": f"WITH {SELECTIONS_SQL} SELECT metric_id, count(DISTINCT run_id) AS n_runs, count(*) AS n_slots, {R('count(DISTINCT run_id) / CAST((SELECT count(DISTINCT run_id) FROM selections) AS DOUBLE)')} AS run_share, {R('count(*) / CAST((SELECT count(*) FROM selections) AS DOUBLE)')} AS slot_share, {R('avg(weight)')} AS weight_mean, {R('sum(weight)')} AS weight_mass FROM selections GROUP BY 1",
    "category_usage": f"""WITH {SELECTIONS_SQL}, per AS (SELECT substr(metric_id, 1, 1) AS category, run_id, count(*) AS n, sum(weight) AS mass FROM selections GROUP BY 1, 2)
        SELECT category, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_slots, {R('median(n)')} AS median_per_run, {R('sum(mass)')} AS weight_mass, {R('sum(mass) / sum(sum(mass)) OVER ()')} AS mass_share FROM per GROUP BY 1""",
    "top_metric_frequency": f"WITH {SELECTIONS_SQL} SELECT metric_id, count(*) AS n_top FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY weight DESC, metric_id) AS rn FROM selections) WHERE rn = 1 GROUP BY 1",
    "weight_entropy": f"WITH {SELECTIONS_SQL} SELECT run_id, count(*) AS n_metrics, {R('CASE WHEN count(*) > 1 THEN -sum(CASE WHEN weight > 0 THEN weight * ln(weight) ELSE 0 END) / ln(count(*)) ELSE 0.0 END')} AS entropy FROM selections GROUP BY 1",
    "signed_rank": f"WITH {SIGNED_SQL} SELECT method, baseline, count(*) AS n, {R('sum(CASE WHEN delta > 0 THEN r ELSE 0 END)')} AS w_plus, {R('sum(CASE WHEN delta < 0 THEN r ELSE 0 END)')} AS w_minus, {R('(sum(CASE WHEN delta > 0 THEN r ELSE 0 END) - sum(CASE WHEN delta < 0 THEN r ELSE 0 END)) / sum(r)')} AS rank_biserial FROM sized GROUP BY 1, 2",
    "effect_sizes": f"WITH {PAIRS_SQL} SELECT method, baseline, count(*) AS n, {R('avg(delta)')} AS mean, CASE WHEN stddev_samp(delta) > 0 THEN {R('avg(delta) / stddev_samp(delta)')} END AS dz, count(*) FILTER (delta >= 1e-3) AS wins, count(*) FILTER (abs(delta) < 1e-3) AS ties, count(*) FILTER (delta <= -1e-3) AS losses FROM pairs GROUP BY 1, 2",
    "holm": f"WITH {TESTS_SQL} SELECT method, hypothesis, p_value, {R('max(least(1.0, (m - rn + 1) * p_value)) OVER (PARTITION BY method ORDER BY rn)')} AS p_holm FROM numbered",
    "bh_fdr": f"WITH {TESTS_SQL} SELECT method, hypothesis, p_value, {R('min(least(1.0, p_value * m / rn)) OVER (PARTITION BY method ORDER BY rn DESC)')} AS q_value FROM numbered",
    "factorial_contrasts": f"""WITH {RUNS_SQL}, cells AS (SELECT method_name, """ + ", ".join(f"max(ari) FILTER ((view_rank > 0) = ({i} = 1) AND (selected_k > 3) = ({j} = 1)) AS c{i}{j}" for i in (0, 1) for j in (0, 1)) + f""" FROM runs GROUP BY 1)
        SELECT method_name, {R('(c10 + c11 - c00 - c01) / 2')} AS effect_a, {R('(c01 + c11 - c00 - c10) / 2')} AS effect_b, {R('c11 - c10 - c01 + c00')} AS interaction FROM cells WHERE c00 IS NOT NULL AND c01 IS NOT NULL AND c10 IS NOT NULL AND c11 IS NOT NULL""",
}
REPRESENTATIVE_SQL = BEST_SQL + """,
per AS (SELECT {k}method_name, avg(best_ari) AS mean, median(best_ari) AS median, stddev_samp(best_ari) AS std, avg(total_runtime_sec) AS runtime FROM best GROUP BY {k}method_name),
placed AS (SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY round_even(mean / 1e-6, 0) DESC NULLS LAST, round_even(median / 1e-6, 0) DESC NULLS LAST, std NULLS LAST, runtime NULLS LAST, method_name) AS place, max(mean) OVER (PARTITION BY {p}) AS top FROM per)
SELECT {k}max(CASE WHEN place = 1 THEN method_name END) AS selected, max(CASE WHEN place = 2 THEN method_name END) AS runner_up, round(max(CASE WHEN place = 1 THEN mean END), 6) AS selected_mean, count(*) FILTER (place > 1 AND top - mean <= 0.001) AS n_equivalent FROM placed {g}"""
ORACLE_SQL["representative"] = "WITH " + REPRESENTATIVE_SQL.format(k="", p="1", g="")
ORACLE_SQL["family_representatives"] = "WITH " + REPRESENTATIVE_SQL.format(k="family, ", p="family", g="GROUP BY family")
#: Steps are unrolled: the pool has five methods.
STEPS = 5
ORACLE_SQL["greedy_portfolio"] = (
    f"WITH {BEST_SQL}, v AS (SELECT dataset_id, method_name AS m, coalesce(best_ari, 0) AS a FROM best), d AS (SELECT DISTINCT dataset_id FROM v), p0 AS (SELECT dataset_id, 0.0 AS now, CAST([] AS VARCHAR[]) AS had FROM d)"
    + "".join(
        f""", c{i} AS (SELECT m, round(avg(greatest(now, coalesce(a, 0))), 12) AS mean FROM (SELECT p{i - 1}.dataset_id, now, had, x.m, v.a FROM p{i - 1} CROSS JOIN (SELECT DISTINCT m FROM v) x LEFT JOIN v ON v.dataset_id = p{i - 1}.dataset_id AND v.m = x.m) WHERE NOT list_contains(had, m) GROUP BY m),
        b{i} AS (SELECT m, mean FROM c{i} ORDER BY mean DESC, m LIMIT 1),
        p{i} AS (SELECT p{i - 1}.dataset_id, greatest(now, coalesce(v.a, 0)) AS now, list_append(had, b{i}.m) AS had FROM p{i - 1} CROSS JOIN b{i} LEFT JOIN v ON v.dataset_id = p{i - 1}.dataset_id AND v.m = b{i}.m)"""
        for i in range(1, STEPS + 1)
    )
    + ", s AS ("
    + " UNION ALL ".join(f"SELECT {i} AS step, m AS method_name, mean AS portfolio_mean FROM b{i}" for i in range(1, STEPS + 1))
    + ") SELECT CAST(step AS INTEGER) AS step, method_name, round(portfolio_mean - coalesce(lag(portfolio_mean) OVER (ORDER BY step), 0), 6) AS gain, round(portfolio_mean, 6) AS portfolio_mean FROM s"
)
ORACLE_SQL["min_portfolio_size"] = f"WITH g AS ({ORACLE_SQL['greedy_portfolio']}) SELECT CAST(min(step) AS INTEGER) AS min_size FROM g WHERE portfolio_mean >= 0.95 * (SELECT max(portfolio_mean) FROM g) - 1e-6"
#: Two-sided normal p of a score, by the series of the error function.
NORMAL_P = "CASE WHEN {0} = 0 THEN 1.0 ELSE 1 - exp(-{0} * {0} / 2) * list_sum(list_transform(range(0, 160), lambda term: exp((2 * term + 1) * ln(abs({0}) / sqrt(2.0)) - lgamma(term + 1.5)))) END".format
ORACLE_SQL["signed_rank_p"] = f"""WITH {SIGNED_SQL}, w AS (SELECT method, baseline, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN delta < 0 THEN r ELSE 0 END) AS w_minus FROM sized GROUP BY 1, 2),
    t AS (SELECT method, baseline, sum(c * c * c - c) AS ties FROM (SELECT method, baseline, CAST(count(*) AS DOUBLE) AS c FROM sized GROUP BY method, baseline, abs(delta)) GROUP BY 1, 2),
    z AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w JOIN t USING (method, baseline))
    SELECT method, baseline, CAST(n AS BIGINT) AS n, {R('w_plus')} AS w_plus, {R('w_minus')} AS w_minus, {R('(w_plus - w_minus) / (w_plus + w_minus)')} AS rank_biserial, {R('z')} AS z, round({NORMAL_P('z')}, 6) AS p_value FROM z"""
