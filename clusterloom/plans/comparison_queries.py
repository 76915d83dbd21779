"""Queries of the comparison suite, the audits and the prediction scores, with their DuckDB SQL.

All read whole tables. Where an audit looks for gaps or faults, some are
planted by the remainder of a number, on both sides; nothing is left out to
save work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, comparisons, frames, learning, portfolio, predictions, ranking, shapes
from ..sources import repository
from ..sources.scratch import written
from .projections import BEST_SQL, POINTS_SQL, RUNS_SQL, SELECTIONS_SQL, TRIALS_SQL, points, rounded, runs, selections, table, trial_metrics, utilities
from .run_queries import ORACLE_SQL as RUN_ORACLES
from .run_queries import NORMAL_P, PAIRS_SQL, RUN_BLOCK, VBS_SQL
from .trial_queries import SCORED_SQL, _scored

#: Declared contrasts of the methods in the projected frames.
CONTRASTS = (("utility_prediction_gap", "click", "error"), ("weighting_gap", "view", "purchase"), ("metric_count_gap", "click", "purchase"))
HYPOTHESES = (("h1", "ari", "click", "error"), ("h2", "ari", "click", "view"), ("h3", "ari", "purchase", "view"))
NEW = ("RF", "AF")


def _best(s, d):
    return frames.best_view_frame(runs(s, d))


def _traces(s, d):
    """Every event of a (user, type, view) is a candidate of its trace."""
    view = F.col("event_id") % 3
    named = F.when(view == 0, "x_only").when(view == 1, "y_only").otherwise("xy_2d")
    ari = F.when(F.col("event_id") % 17 != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 250.0)))
    raw = table(s, d, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_type").alias("method_name"), named.alias("view_id"), ari.alias("ari"))
    return raw.groupBy("dataset_id", "method_name", "view_id").agg(F.max("ari").alias("trace_best_ari"), F.count("*").alias("n_trace_candidates"))


TRACE_SQL = BEST_SQL + """,
traces AS (SELECT user_id AS dataset_id, event_type AS method_name, CASE event_id % 3 WHEN 0 THEN 'x_only' WHEN 1 THEN 'y_only' ELSE 'xy_2d' END AS best_view,
    max(CASE WHEN event_id % 17 <> 0 THEN greatest(0.0, least(1.0, value / 250.0)) END) AS trace_best_ari, count(*) AS n_trace_candidates FROM events GROUP BY 1, 2, 3),
attached AS (SELECT best.*, trace_best_ari, n_trace_candidates, trace_best_ari - best_ari AS trace_gap FROM best LEFT JOIN traces USING (dataset_id, best_view, method_name))"""


def _usage(s, d):
    """Each order's selection, under the dataset and method that its number gives."""
    keyed = selections(s, d).withColumns({"dataset_id": F.col("run_id"), "method_name": F.when(F.col("run_id") % 2 == 0, "click").otherwise("error")})
    return comparisons.new_metric_usage_per_run(keyed, NEW, ["dataset_id", "method_name"])


USAGE_SQL = SELECTIONS_SQL + """,
usage AS (SELECT run_id AS dataset_id, CASE WHEN run_id % 2 = 0 THEN 'click' ELSE 'error' END AS method_name, count(*) AS n_selected, count(*) FILTER (metric_id IN ('RF', 'AF')) AS new_count,
    coalesce(sum(weight) FILTER (metric_id IN ('RF', 'AF')), 0) AS new_mass, sum(weight) AS total, arg_max(metric_id, (weight, metric_id)) IN ('RF', 'AF') AS top_is_new FROM selections GROUP BY run_id)"""


def _vectors(s, d):
    """A true and a predicted utility a metric: mean scores of all candidates, and of those that are valid."""
    mean = lambda c: F.round(F.avg(c), 6)
    return trial_metrics(s, d).groupBy("dataset_id", "metric_id").agg(mean("score").alias("truth"), F.coalesce(mean(F.when(F.col("valid"), F.col("score"))), F.lit(0.0)).alias("predicted"))


VECTORS_SQL = TRIALS_SQL + """,
vectors AS (SELECT dataset_id, metric_id, round(avg(score), 6) AS truth, coalesce(round(avg(score) FILTER (valid), 6), 0.0) AS predicted FROM trials GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY truth DESC, metric_id) AS t, row_number() OVER (PARTITION BY dataset_id ORDER BY predicted DESC, metric_id) AS p FROM vectors)"""
SIZES_SQL = VECTORS_SQL + """,
near AS (SELECT dataset_id, count(*) FILTER (greatest(0.0, least(1.0, truth)) >= 0.92 * tt) AS t, count(*) FILTER (greatest(0.0, least(1.0, predicted)) >= 0.92 * pp) AS p FROM (
    SELECT *, max(greatest(0.0, least(1.0, truth))) OVER (PARTITION BY dataset_id) AS tt, max(greatest(0.0, least(1.0, predicted))) OVER (PARTITION BY dataset_id) AS pp FROM vectors) GROUP BY 1),
sizes AS (SELECT dataset_id, CAST(CASE WHEN t <= 5 THEN t ELSE ceil((t + 5) / 2.0) END AS INTEGER) AS k_true, CAST(CASE WHEN p <= 5 THEN p ELSE ceil((p + 5) / 2.0) END AS INTEGER) AS k_predicted FROM near)"""


def _evaluations(s, d):
    return _scored(s, d).select(F.col("dataset_id").alias("record_id"), F.col("candidate").alias("config_id"), F.concat(F.lit("a"), (F.col("candidate") % 5).cast("string")).alias("algorithm"), F.round("ari", 9).alias("ari"), F.col("valid").alias("valid_result"), "objective")


def _records(s, d):
    ids = trial_metrics(s, d).select(F.col("dataset_id").alias("record_id")).distinct()
    return ids.select("record_id", (F.col("record_id") % 5).alias("family"), (F.col("record_id") % 10).alias("subfamily"))


EVALUATIONS_SQL = SCORED_SQL + """,
evaluations AS (SELECT dataset_id AS record_id, candidate AS config_id, 'a' || (candidate % 5) AS algorithm, round(ari, 9) AS ari, valid AS valid_result, objective FROM scored),
records AS (SELECT DISTINCT dataset_id AS record_id, dataset_id % 5 AS family, dataset_id % 10 AS subfamily FROM scored)"""


def _parts(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("dataset_id"), (F.col("p_partkey") % 16 + 1).alias("split_id"), F.col("p_brand").alias("family"), F.col("p_type").alias("subfamily"), F.col("p_size").alias("cluster_count"))


PARTS_SQL = "parts AS (SELECT p_partkey AS dataset_id, p_partkey % 16 + 1 AS split_id, p_brand AS family, p_type AS subfamily, p_size AS cluster_count FROM part)"


def _deltas(s, d):
    return comparisons.all_pairs(_best(s, d))


def _no_p(df):
    return rounded(df.drop("p_value", "p_holm", "t_p", "low", "high"))


def _wide(s, d):
    return comparisons.pivot_arms(_best(s, d), ["click", "error", "view"], _best(s, d).select("dataset_id", "family").distinct())


QUERIES = {
    "trace_gap_rows": lambda s, d: rounded(comparisons.attach_trace_gap(_best(s, d), _traces(s, d)).select("dataset_id", "method_name", "best_view", "trace_best_ari", "n_trace_candidates", "trace_gap")),
    "trace_gap_summary": lambda s, d: rounded(comparisons.trace_gap_summary(comparisons.attach_trace_gap(_best(s, d), _traces(s, d)))),
    "view_summary": lambda s, d: rounded(comparisons.view_summary(runs(s, d))),
    "pivot_arms": lambda s, d: rounded(_wide(s, d)),
    "arm_contrasts": lambda s, d: rounded(comparisons.arm_contrasts(_wide(s, d), [("a", "click", "error"), ("b", "click", "view"), ("c", "error", "view")])),
    "top_k_comparison": lambda s, d: rounded(comparisons.top_k_comparison(runs(s, d).withColumn("weight_entropy", F.col("selected_k") / 5), {"click": 1, "error": 3, "view": 5})),
    "external_metric_table": lambda s, d: rounded(comparisons.external_metric_table(runs(s, d), ["ari", "runtime_sec"])),
    "new_metric_usage_per_run": lambda s, d: rounded(_usage(s, d)),
    "new_metric_usage": lambda s, d: rounded(comparisons.new_metric_usage(_usage(s, d))),
    "new_metric_gain": lambda s, d: rounded(comparisons.new_metric_gain(_usage(s, d).withColumn("new_mass", F.round("new_mass", 9)), _best(s, d).withColumn("best_ari", F.round("best_ari", 9)), "view"), 5),
    "enrichment": lambda s, d: rounded(comparisons.enrichment(selections(s, d).withColumn("g", F.col("run_id") % 7), "g")),
    "metric_master": lambda s, d: rounded(comparisons.metric_master(utilities(s, d).select("metric_id").distinct(), utilities(s, d).groupBy("metric_id").agg(F.avg("utility").alias("utility")), ranking.top_k(utilities(s, d), 1, ["dataset_id"]).groupBy("metric_id").agg(F.count("*").cast("double").alias("n_top")))),
    "paired_predictions": lambda s, d: comparisons.paired_predictions(runs(s, d).filter("method_name = 'click'"), runs(s, d).filter("method_name = 'error'"), "selected_k"),
    "verify_released": lambda s, d: rounded(comparisons.verify_released(runs(s, d), _best(s, d).filter("best_ari is not null and dataset_id % 9 <> 0").select("dataset_id", "method_name", (F.col("best_ari") + (F.col("dataset_id") % 10 == 0).cast("double") / 100).alias("released")))),
    "gap_table": lambda s, d: rounded(comparisons.gap_table(_best(s, d), CONTRASTS)),
    "gap_table_by_family": lambda s, d: rounded(comparisons.gap_table(_best(s, d), CONTRASTS, ["family"])),
    "external_gaps": lambda s, d: rounded(comparisons.gap_table(_best(s, d), comparisons.external_contrasts(["view", "purchase"], ["click", "error"]))),
    "criterion_table": lambda s, d: rounded(comparisons.criterion_table(_best(s, d), "click")),
    "paired_t": lambda s, d: _no_p(comparisons.paired_t(_deltas(s, d), ["method", "baseline"])),
    "paired_t_p": lambda s, d: rounded(comparisons.paired_t(_deltas(s, d), ["method", "baseline"])),
    "paired_contrast": lambda s, d: rounded(comparisons.paired_contrast(_deltas(s, d), ["method", "baseline"])),
    "hypothesis_statistics": lambda s, d: _no_p(comparisons.run_hypotheses(_best(s, d), HYPOTHESES, ["family"])),
    "hypotheses": lambda s, d: rounded(comparisons.run_hypotheses(_best(s, d), HYPOTHESES)),
    "mann_whitney": lambda s, d: rounded(comparisons.mann_whitney(_best(s, d).withColumn("inside", F.col("family") < 4), ["method_name"], "inside", "best_ari")),
    "bootstrap_columns": lambda s, d: rounded(comparisons.bootstrap_columns(_best(s, d), ["best_ari", "view_mean"], "dataset_id")),
    "family_divergence": lambda s, d: rounded(comparisons.family_divergence(_best(s, d))),
    "global_choice_by_family": lambda s, d: rounded(comparisons.global_choice_by_family(_best(s, d))),
    "selection_winners": lambda s, d: comparisons.selection_winners(_best(s, d)),
    "stability_by_family": lambda s, d: comparisons.stability_by(_best(s, d)),
    "greedy_membership": lambda s, d: rounded(comparisons.greedy_membership(portfolio.greedy_portfolio(_best(s, d))), 4),
    "matched_sizes": lambda s, d: comparisons.matched_sizes(portfolio.random_subset_curve(_best(s, d))),
    "vbs_problems": lambda s, d: comparisons.vbs_problems(_broken(portfolio.virtual_best(_best(s, d))), _best(s, d)),
    "frame_problems": lambda s, d: comparisons.frame_problems(runs(s, d), _best(s, d)),
    "capability_matrix": lambda s, d: comparisons.capability_matrix(runs(s, d)),
    "preflight": lambda s, d: comparisons.preflight(comparisons.capability_matrix(runs(s, d)), ["click", "error", "absent"], ["best_view", "k_analysis", "vbs"]),
    "comparison_suite": lambda s, d: rounded(comparisons.run_suite(runs(s, d), {"methods": ["click", "error", "view", "@representative:leader"], "contrasts": [["g", "click", "@representative:leader"]], "scope": "family"}, {"leader": "purchase"})["gaps"]),
    "representative_frame": lambda s, d: rounded(comparisons.representative_frame(_best(s, d)).select("representative_id", "dataset_id", "method_name", "best_ari")),
    "candidate_sources": lambda s, d: comparisons.candidate_sources(utilities(s, d).select("metric_id").distinct().filter("metric_id <> 'm_tax'"), utilities(s, d).select("metric_id").distinct().filter("metric_id = 'm_tax'"), utilities(s, d).groupBy("metric_id").agg(F.count("*").alias("n"))),
    "ordered_summary": lambda s, d: rounded(comparisons.ordered_summary(runs(s, d), ["view_id", "method_name"], by_mean=True)),
    "repository_counts": lambda s, d: audits.repository_counts({"records": (_records(s, d), ["record_id"]), "evaluations": (_evaluations(s, d), ["record_id", "algorithm"]), "failures": (_evaluations(s, d).filter("not valid_result"), ["record_id"])}),
    "config_coverage": lambda s, d: audits.config_coverage(_evaluations(s, d).filter("record_id % 7 <> 0 or config_id < 30"), "record_id", "config_id"),
    "family_coverage": lambda s, d: audits.family_coverage(_records(s, d), _evaluations(s, d).filter("record_id % 6 <> 0"), _evaluations(s, d).filter("not valid_result"), "record_id"),
    "failure_analysis": lambda s, d: rounded(audits.failure_analysis(_evaluations(s, d).filter("not valid_result").withColumn("reason", F.when(F.col("ari") > 0.5, "late").otherwise("early")), ["algorithm", "reason"])),
    "split_summary": lambda s, d: audits.split_summary(_parts(s, d)),
    "keep_splits": lambda s, d: audits.keep_splits(_parts(s, d), [2, 5]).select("dataset_id", "split_id"),
    "dynamic_k_distribution": lambda s, d: audits.dynamic_k_distribution(utilities(s, d), ["dataset_id"]),
    "job_counts": lambda s, d: audits.job_counts(_parts(s, d)).withColumns({"level": F.col("level").cast("long"), "cluster_count": F.col("cluster_count").cast("double")}),
    "best_algorithm": lambda s, d: rounded(audits.best_algorithm(_evaluations(s, d), _records(s, d))),
    "ari_regression_rows": lambda s, d: rounded(audits.ari_regression_rows(_evaluations(s, d), _records(s, d), ["objective", "absent"])),
    "slate_problems": lambda s, d: audits.slate_problems(_evaluations(s, d).filter("record_id % 7 <> 0 or config_id < 30").withColumn("valid", F.col("valid_result")), ["record_id"], ["algorithm", "config_id"], ["objective"]),
    "eligible_trials": lambda s, d: audits.eligible(_scored(s, d).withColumn("n_clusters", F.col("candidate") % 4)).select("dataset_id", "candidate"),
    "warmstart": lambda s, d: audits.warmstart(_scored(s, d).withColumn("ari", F.round("ari", 9)), ["dataset_id"]).select("dataset_id", "candidate", "position"),
    "metric_key": lambda s, d: _shown(s, d).withColumn("key", audits.metric_key(F.col("name"), {"davies_bouldin": "davies_bouldin", "m_tax": "m_tax", "SDbw": "s_dbw"})),
    "top1_scores": lambda s, d: rounded(predictions.top1_scores(_vectors(s, d), ["dataset_id"])),
    "top_k_scores": lambda s, d: rounded(predictions.top_k_scores(_vectors(s, d), ["dataset_id"], 2)),
    "rank_scores": lambda s, d: rounded(predictions.rank_scores(_vectors(s, d), ["dataset_id"])),
    "score_suite": lambda s, d: rounded(predictions.score_suite(_vectors(s, d), ["dataset_id"], (2,), (2,)), 5),
    "dynamic_k_scores": lambda s, d: rounded(predictions.dynamic_k_scores(predictions.both_sizes(_vectors(s, d), ["dataset_id"]))),
    "dynamic_k_confusion": lambda s, d: predictions.dynamic_k_confusion(predictions.both_sizes(_vectors(s, d), ["dataset_id"])),
    "resolve_weights": lambda s, d: rounded(predictions.resolve_weights(utilities(s, d), ["dataset_id"], 3)),
    "resolve_weights_dynamic": lambda s, d: rounded(predictions.resolve_weights(utilities(s, d).withColumn("metric_id", F.concat(F.lit("utility__"), "metric_id")), ["dataset_id"], "dynamic", "normalized_positive", pool=["m_price", "m_quantity", "m_tax"])),
    "weights_with_fallback": lambda s, d: rounded(predictions.with_fallback(predictions.resolve_weights(utilities(s, d).filter("dataset_id % 3 <> 0"), ["dataset_id"], 1), utilities(s, d), ["dataset_id"], {"silhouette": 0.6, "s_dbw": 0.4})),
    "neighbour_grid": lambda s, d: table(s, d, "part").select(F.col("p_brand").alias("family")).distinct().join(F.broadcast(s.createDataFrame(predictions.neighbour_grid(), "config_id string, n_neighbors int, scaler string, distance string, weighting string"))),
    "grid_predictions": lambda s, d: rounded(predictions.grid_predictions(_neighbours(s, d), utilities(s, d), (1, 3, 5))),
    "fold_composite": lambda s, d: rounded(predictions.fold_composite(_fold_scores(s, d), {"errors": {"mae": False}, "tops": {"hit": True, "rank": False}}, "metric_id")),
    "selector_scores": lambda s, d: rounded(predictions.selector_scores(runs(s, d).filter("method_name = 'click' and ari is not null").select("dataset_id", "view_id", "ari"), runs(s, d).filter("ari is not null").select("dataset_id", "view_id", F.col("method_name").alias("policy_id"), "ari"))),
    "nearest_label": lambda s, d: _nearest_label(s, d),
    "within_patience": lambda s, d: learning.within_patience(_scored(s, d), ["dataset_id"], 3).select("dataset_id", "candidate"),
    "config_block": lambda s, d: _configs(s, d).select("dataset_id", "candidate", *learning.config_block(["kmeans", "hdbscan_constrained"], ["n_clusters"], ["linkage"])),
    "hidden_values": lambda s, d: learning.hidden_values(_masked(s, d), ["m_price", "m_tax"]),
    "policy_rows": lambda s, d: rounded(_policy_rows(s, d)),
    "candidate_trace": lambda s, d: learning.candidate_trace(_scored(s, d), {"objective": lambda _: F.col("objective"), "negated": lambda _: -F.col("objective")}),
    "cloud_structure": lambda s, d: rounded(learning.cloud_structure(points(s, d), ["dataset_id"])),
    "landmark_scores": lambda s, d: learning.landmark_scores(points(s, d), ["dataset_id"]),
    "wide_trials": lambda s, d: rounded(_plain(repository.wide_trials(trial_metrics(s, d).withColumns({"raw": F.col("score"), "norm": F.least(F.lit(1.0), "score")}), ["dataset_id", "candidate"], {"m_price": 0.5, "m_tax": 1.0})), 7),
    "column_roles": lambda s, d: _unified(s, d),
    "training_rows": lambda s, d: rounded(_training(s, d)[0]),
    "missing_utilities": lambda s, d: _training(s, d)[1],
    "shape_counts": lambda s, d: shapes.generate(_shape_jobs(s, d), ["dataset_id", "shape"]).groupBy("shape").agg(F.count("*").alias("n"), F.countDistinct("dataset_id").alias("clouds")),
}


def _plain(df):
    """Columns without blanks, dots and signs in their names."""
    return df.toDF(*(c.replace(" (w=", "_w").replace(".", "_").replace(")", "") for c in df.columns))


def _configs(s, d):
    named = F.when(F.col("candidate") % 2 == 0, "kmeans").otherwise("hdbscan_constrained-4")
    return _scored(s, d).select("dataset_id", "candidate", named.alias("algorithm"), F.when(F.col("candidate") % 2 == 0, '{"n_clusters": 3}').otherwise("{}").alias("config"))


def _masked(s, d):
    """A feature table in which the tax of every third supplier is carried although it is not observed."""
    wide = utilities(s, d).groupBy("dataset_id").agg(*(F.max(F.when(F.col("metric_id") == m, F.col("utility"))).alias(f"value__{m}") for m in ("m_price", "m_tax")))
    return wide.withColumn("observed", F.when(F.col("dataset_id") % 3 == 0, F.array(F.lit("m_price"))).otherwise(F.array(F.lit("m_price"), F.lit("m_tax"))))


def _policy_rows(s, d):
    per = runs(s, d).filter("ari is not null")
    meta = per.groupBy("dataset_id", "view_id").agg(F.avg("runtime_sec").alias("runtime"))
    profile = per.select("dataset_id", "view_id", F.col("method_name").alias("metric_id"), (F.col("selected_k") / 5).alias("utility"))
    met = learning.policy_rows(meta, profile, per.select("dataset_id", "view_id", F.col("method_name").alias("policy_id"), "ari"))
    return met.select("dataset_id", "view_id", "runtime", F.element_at("utilities", "click").alias("u_click"), F.element_at("ari_by_policy", "view").alias("p_view"), F.size("ari_by_policy").alias("n"))


def _unified(s, d):
    """Rows of the training table by split, after the check of its columns."""
    table_ = _wide_utilities(s, d).withColumn("a", F.col("dataset_id").cast("string"))
    splits = _wide_utilities(s, d).select("dataset_id", (F.col("dataset_id") % 4).alias("split_id"))
    met = repository.unified_table(table_, splits, ["dataset_id"], 1, 2)
    return rounded(met.groupBy("split_id").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.avg("utility__m_price").alias("u")))


def _wide_utilities(s, d):
    return utilities(s, d).groupBy("dataset_id").agg(*(F.max(F.when(F.col("metric_id") == m, F.col("utility"))).alias(f"utility__{m}") for m in ("m_price", "m_tax")))


def _training(s, d):
    """Features of all suppliers and view, utilities of those whose number is no multiple of 5."""
    ids = utilities(s, d).select("dataset_id").distinct().withColumns({"view_id": F.lit("x_only"), "family": F.lit("f"), "subfamily": F.lit("s"), "a": F.col("dataset_id") * 2})
    return repository.training_rows(ids, utilities(s, d).filter("dataset_id % 5 <> 0").withColumn("view_id", F.lit("x_only")), ["m_price", "m_tax"])


def _shape_jobs(s, d):
    """A cloud of 50 points a supplier, shapes in turn."""
    plan = '{"components": [{"id": "a", "shape": "%s", "n": 50, "profiles": {"texture": "granular", "curvature": "amplify"}}]}'
    names, k = sorted(shapes.SHAPES), F.col("s_suppkey")
    at = (k % len(names) + 1).cast("int")
    return table(s, d, "supplier").select(k.alias("dataset_id"), F.array(*map(F.lit, names))[at - 1].alias("shape"), k.cast("long").alias("seed"), F.array(*(F.lit(plan % n) for n in names))[at - 1].alias("plan"))


def _shown(s, d):
    """Display names of metrics beside the events that report them; some are unknown, some missing."""
    kind = F.col("event_type")
    name = F.when(kind == "click", "Davies Bouldin").when(kind == "view", "m_tax").when(kind == "error", " S-Dbw ").when(kind == "signup", "nothing")
    return table(s, d, "events").select("event_id", name.alias("name"))


def _broken(vbs):
    """A virtual best with planted faults."""
    return vbs.withColumns({"portfolio_runtime_sec": F.when(F.col("dataset_id") % 11 == 0, F.col("portfolio_runtime_sec") + 1).otherwise(F.col("portfolio_runtime_sec")), "winner": F.when(F.col("dataset_id") % 13 == 0, "nobody").otherwise(F.col("winner"))})


def _neighbours(s, d):
    """The five suppliers with the next numbers, at distances that grow."""
    ids = utilities(s, d).select("dataset_id").distinct()
    near = ids.select(F.col("dataset_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("position"))
    made = near.select("query_id", (F.col("query_id") + F.col("position")).alias("neighbour_id"), (F.col("position") + (F.col("query_id") % 4 == 0).cast("int") * -1).cast("double").alias("distance"), "position")
    return made.join(ids.withColumnRenamed("dataset_id", "neighbour_id"), "neighbour_id")


def _fold_scores(s, d):
    return trial_metrics(s, d).groupBy((F.col("dataset_id") % 3).alias("fold"), "metric_id").agg(F.round(F.avg(F.abs(F.col("score") - F.col("ari"))), 6).alias("mae"), F.round(F.avg("score"), 6).alias("hit"), F.round(F.max("score"), 6).alias("rank"))


def _nearest_label(s, d):
    # A row a supplier each, which the join reads more than once.
    facts = written(utilities(s, d).groupBy(F.col("dataset_id").alias("record_id")).agg(*(F.max(F.when(F.col("metric_id") == m, F.col("utility"))).alias(m) for m in ("m_price", "m_quantity", "m_tax"))), "facts")
    labels = written(audits.best_algorithm(_evaluations(s, d)).select("record_id", "best_algorithm"), "labels")
    return rounded(predictions.nearest_label(facts, facts, labels, ["m_price", "m_quantity", "m_tax"]))


R = "round({0}, 6)".format
GAP_SQL = """count(*) AS n, round(avg(delta), 6) AS gap_mean, round(median(delta), 6) AS gap_median, round(stddev_samp(delta), 6) AS gap_std, round(quantile_cont(delta, 0.25), 6) AS gap_q25, round(quantile_cont(delta, 0.75), 6) AS gap_q75,
    round(avg(CAST(delta > 1e-12 AS DOUBLE)), 6) AS reference_better, round(avg(CAST(abs(delta) <= 1e-12 AS DOUBLE)), 6) AS equal, round(avg(CAST(delta < -1e-12 AS DOUBLE)), 6) AS comparison_better"""
DECLARED_SQL = "declared AS (SELECT * FROM (VALUES " + ", ".join(map(str, CONTRASTS)) + ") AS v(gap_type, method, baseline))"
HYPOTHESES_SQL = "declared AS (SELECT * FROM (VALUES " + ", ".join(map(str, HYPOTHESES)) + ") AS v(hypothesis, test_family, method, baseline))"
EXTERNAL_SQL = "declared AS (SELECT * FROM (VALUES ('external_leader_gap', 'view', 'click'), ('external_leader_gap', 'view', 'error'), ('external_leader_gap', 'purchase', 'click'), ('external_leader_gap', 'purchase', 'error')) AS v(gap_type, method, baseline))"
EFFECT_SQL = "count(*) AS n, round(avg(delta), 6) AS mean, CASE WHEN stddev_samp(delta) > 0 THEN round(avg(delta) / stddev_samp(delta), 6) END AS dz, count(*) FILTER (delta >= 1e-3) AS wins, count(*) FILTER (abs(delta) < 1e-3) AS ties, count(*) FILTER (delta <= -1e-3) AS losses"
WIDE_SQL = BEST_SQL + """,
wide AS (SELECT dataset_id, min(family) AS family, max(best_ari) FILTER (method_name = 'click') AS click, max(best_ari) FILTER (method_name = 'error') AS error, max(best_ari) FILTER (method_name = 'view') AS "view" FROM best GROUP BY 1)"""
PICK_SQL = BEST_SQL + """,
per AS (SELECT family, method_name, avg(best_ari) AS mean, median(best_ari) AS median, stddev_samp(best_ari) AS std, avg(total_runtime_sec) AS runtime FROM best GROUP BY 1, 2),
whole AS (SELECT method_name, avg(best_ari) AS mean, median(best_ari) AS median, stddev_samp(best_ari) AS std, avg(total_runtime_sec) AS runtime FROM best GROUP BY 1),
chosen AS (SELECT family, method_name, mean FROM per QUALIFY row_number() OVER (PARTITION BY family ORDER BY round_even(mean / 1e-6, 0) DESC NULLS LAST, round_even(median / 1e-6, 0) DESC NULLS LAST, std NULLS LAST, runtime NULLS LAST, method_name) = 1),
leader AS (SELECT method_name FROM whole ORDER BY round_even(mean / 1e-6, 0) DESC NULLS LAST, round_even(median / 1e-6, 0) DESC NULLS LAST, std NULLS LAST, runtime NULLS LAST, method_name LIMIT 1)"""
MEAN = "SELECT '{0}' AS score, avg({1}) AS value FROM {2}".format
SUITE_SQL = VECTORS_SQL + """,
one AS (SELECT dataset_id, CAST(max(t) FILTER (p = 1) = 1 AS INTEGER) AS hit, max(t) FILTER (p = 1) - 1 AS rank_distance, abs(max(truth) - max(truth) FILTER (p = 1)) AS utility_error, abs(max(predicted) FILTER (p = 1) - max(truth) FILTER (p = 1)) AS calibration_error FROM placed GROUP BY 1),
ranks AS (SELECT dataset_id, coalesce(corr(t, p), 0) AS spearman, avg(abs(t - p)) AS displacement_mean, median(abs(t - p)) AS displacement_median, max(abs(t - p)) AS displacement_max FROM placed GROUP BY 1),
signs AS (SELECT dataset_id, sign(a.truth - b.truth) * sign(a.predicted - b.predicted) AS s FROM vectors a JOIN vectors b USING (dataset_id) WHERE a.metric_id < b.metric_id),
pairs AS (SELECT dataset_id, avg(CAST(s > 0 AS DOUBLE)) AS pairwise FROM signs WHERE s <> 0 GROUP BY 1),
ranked AS (SELECT ranks.*, pairwise, 2 * pairwise - 1 AS kendall FROM ranks LEFT JOIN pairs USING (dataset_id)),
tops AS (SELECT dataset_id, count(*) FILTER (t <= 2 AND p <= 2) / CAST(least(2, count(*)) AS DOUBLE) AS overlap, count(*) FILTER (t <= 2 AND t = p) / CAST(least(2, count(*)) AS DOUBLE) AS ordered,
    count(*) FILTER (t <= 2 AND p <= 2) / CAST(count(*) FILTER (t <= 2 OR p <= 2) AS DOUBLE) AS jaccard, sum(abs(predicted - truth)) FILTER (t <= 2 OR p <= 2) AS abs_error, sum((predicted - truth) ** 2) FILTER (t <= 2 OR p <= 2) AS squared_error, count(*) FILTER (t <= 2 OR p <= 2) AS n_union FROM placed GROUP BY 1),
gains AS (SELECT dataset_id, coalesce(sum(truth / log2(p + 1)) / nullif(sum(truth / log2(t + 1)), 0), 0) AS g, coalesce(sum(truth / log2(p + 1)) FILTER (p <= 2) / nullif(sum(truth / log2(t + 1)) FILTER (t <= 2), 0), 0) AS g2 FROM placed GROUP BY 1)"""
SCORES_SQL = " UNION ALL ".join(
    ["SELECT 'mse' AS score, avg((predicted - truth) ** 2) AS value FROM vectors", "SELECT 'rmse', sqrt(avg((predicted - truth) ** 2)) FROM vectors", "SELECT 'mae', avg(abs(predicted - truth)) FROM vectors", "SELECT 'r2', 1 - sum((predicted - truth) ** 2) / (var_pop(truth) * count(*)) FROM vectors"]
    + [MEAN(f"top1_{c}", c, "one") for c in ("hit", "rank_distance", "utility_error", "calibration_error")]
    + [MEAN(c, c, "ranked") for c in ("spearman", "kendall", "pairwise", "displacement_mean", "displacement_median", "displacement_max")]
    + [MEAN(f"top2_{c}", c, "tops") for c in ("overlap", "ordered", "jaccard")]
    + ["SELECT 'top2_utility_mae', sum(abs_error) / sum(n_union) FROM tops", "SELECT 'top2_utility_rmse', sqrt(sum(squared_error) / sum(n_union)) FROM tops", MEAN("ndcg@2", "g2", "gains"), MEAN("ndcg@all", "g", "gains")]
)
UTIL_SQL = TRIALS_SQL + ", utilities AS (SELECT dataset_id, metric_id, round(avg(score), 6) AS utility FROM trials GROUP BY 1, 2)"
CAPABLE_SQL = RUNS_SQL + """,
unit AS (SELECT dataset_id, method_name, count(DISTINCT view_id) AS v, bool_and(runtime_sec IS NOT NULL) AS timed FROM runs GROUP BY 1, 2),
units AS (SELECT method_name, avg(CAST(v >= 3 AS DOUBLE)) >= 0.99 AS three_views, avg(CAST(timed AS DOUBLE)) >= 0.99 AS all_view_runtime FROM unit GROUP BY 1),
able AS (SELECT method_name, count(*) AS n_runs, count(*) FILTER (status = 'success') AS n_success, avg(CAST(status <> 'missing' AS DOUBLE)) >= 0.99 AS raw_result, coalesce(avg(CAST(ari IS NOT NULL AS DOUBLE)) FILTER (status = 'success') >= 0.99, false) AS external_ari,
    coalesce(avg(CAST(selected_k IS NOT NULL AS DOUBLE)) FILTER (status = 'success') >= 0.99, false) AS selected_k, coalesce(avg(CAST(true_k IS NOT NULL AS DOUBLE)) FILTER (status = 'success') >= 0.99, false) AS true_k, avg(CAST(runtime_sec IS NOT NULL AS DOUBLE)) >= 0.99 AS runtime FROM runs GROUP BY 1),
matrix AS (SELECT * FROM able JOIN units USING (method_name))"""
LACKS = lambda cs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{c}' END" for c in cs) + "], lambda x: x IS NOT NULL), ';')"
GRID_SQL = UTIL_SQL + """,
ids AS (SELECT DISTINCT dataset_id FROM utilities),
found AS (SELECT q.dataset_id AS query_id, n.dataset_id AS neighbour_id, CAST(n.dataset_id - q.dataset_id AS INTEGER) AS position, CAST(n.dataset_id - q.dataset_id - CASE WHEN q.dataset_id % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS distance FROM ids q JOIN ids n ON n.dataset_id BETWEEN q.dataset_id + 1 AND q.dataset_id + 5),
weighed AS (SELECT *, CASE WHEN min(distance) OVER (PARTITION BY query_id) <= 1e-12 THEN CAST(distance <= 1e-12 AS DOUBLE) ELSE 1 / (distance + 1e-12) END AS w FROM found),
met AS (SELECT weighed.*, metric_id, utility FROM weighed JOIN utilities ON dataset_id = neighbour_id),
sized AS (SELECT unnest([1, 3, 5]) AS n_neighbors)"""

ORACLE_SQL = {
    "trace_gap_rows": f"WITH {TRACE_SQL} SELECT dataset_id, method_name, best_view, {R('trace_best_ari')} AS trace_best_ari, n_trace_candidates, {R('trace_gap')} AS trace_gap FROM attached",
    "trace_gap_summary": f"""WITH {TRACE_SQL} SELECT method_name, count(*) AS n_with_trace, {R('avg(trace_best_ari)')} AS trace_best_mean, {R('avg(best_ari)')} AS selected_mean, {R('avg(trace_gap)')} AS gap_mean, {R('median(trace_gap)')} AS gap_median,
        {R('quantile_cont(trace_gap, 0.75)')} AS gap_q75, {R('max(trace_gap)')} AS gap_max, {R('avg(CAST(abs(trace_gap) <= 1e-12 AS DOUBLE))')} AS trace_best_rate, {R('avg(n_trace_candidates)')} AS n_candidates_mean FROM attached WHERE trace_gap IS NOT NULL GROUP BY 1""",
    "view_summary": f"""WITH {BEST_SQL} SELECT method_name, {R('avg(best_ari)')} AS best_view_mean, {R('sum(view_mean * n_success) / sum(n_success)')} AS all_views_mean, count(*) FILTER (best_view = 'x_only') AS best_view_x_only,
        count(*) FILTER (best_view = 'y_only') AS best_view_y_only, count(*) FILTER (best_view = 'xy_2d') AS best_view_xy_2d FROM best GROUP BY 1""",
    "pivot_arms": f"WITH {WIDE_SQL} SELECT dataset_id, {R('click')} AS click, {R('error')} AS error, round(\"view\", 6) AS \"view\", family FROM wide",
    "arm_contrasts": f"""WITH {WIDE_SQL}, x AS (SELECT 'a' AS label, click - error AS delta FROM wide UNION ALL SELECT 'b', click - "view" FROM wide UNION ALL SELECT 'c', error - "view" FROM wide)
        SELECT label, count(*) AS n, {R('avg(delta)')} AS mean, {R('median(delta)')} AS median, {R('avg(CAST(delta > 0 AS DOUBLE))')} AS positive_share FROM x WHERE delta IS NOT NULL GROUP BY 1""",
    "top_k_comparison": f"""WITH {RUNS_SQL} SELECT method_name, count(*) AS n, {R('avg(ari)')} AS ari_mean, {R('median(ari)')} AS ari_median, round(avg(runtime_sec) FILTER (ari IS NOT NULL), 6) AS runtime_mean, round(avg(selected_k / 5.0) FILTER (status = 'success'), 6) AS entropy_mean,
        CASE method_name WHEN 'click' THEN 1 WHEN 'error' THEN 3 ELSE 5 END AS top_k FROM runs WHERE method_name IN ('click', 'error', 'view') GROUP BY 1""",
    "external_metric_table": f"WITH {RUNS_SQL} SELECT method_name, count(*) AS n, {R('avg(ari)')} AS mean_ari, {R('stddev_samp(ari)')} AS std_ari, {R('avg(runtime_sec)')} AS mean_runtime_sec, {R('stddev_samp(runtime_sec)')} AS std_runtime_sec FROM runs WHERE status = 'success' GROUP BY 1",
    "new_metric_usage_per_run": f"WITH {USAGE_SQL} SELECT dataset_id, method_name, n_selected, new_count, {R('new_mass')} AS new_mass, {R('new_count / CAST(n_selected AS DOUBLE)')} AS new_fraction, {R('new_mass / nullif(total, 0)')} AS new_share, top_is_new FROM usage",
    "new_metric_usage": f"""WITH {USAGE_SQL} SELECT method_name, count(*) AS n_runs, {R('avg(new_count)')} AS count_mean, {R('avg(new_count / CAST(n_selected AS DOUBLE))')} AS fraction_mean, {R('median(new_count / CAST(n_selected AS DOUBLE))')} AS fraction_median,
        {R('avg(new_mass)')} AS mass_mean, {R('avg(new_mass / nullif(total, 0))')} AS share_mean, {R('avg(CAST(new_count > 0 AS DOUBLE))')} AS with_new, {R('avg(CAST(top_is_new AS DOUBLE))')} AS top_new FROM usage GROUP BY 1""",
    "new_metric_gain": f"""WITH {BEST_SQL}, {USAGE_SQL}, met AS (SELECT u.method_name, round(new_mass, 9) AS new_mass, round(b.best_ari, 9) - round(r.best_ari, 9) AS gain FROM usage u JOIN best b USING (dataset_id, method_name) JOIN best r ON r.dataset_id = u.dataset_id AND r.method_name = 'view'),
        told AS (SELECT *, rank() OVER (PARTITION BY method_name ORDER BY new_mass) + (count(*) OVER (PARTITION BY method_name, new_mass) - 1) / 2.0 AS x, rank() OVER (PARTITION BY method_name ORDER BY gain) + (count(*) OVER (PARTITION BY method_name, gain) - 1) / 2.0 AS y FROM met WHERE gain IS NOT NULL)
        SELECT method_name, count(*) AS n, round(avg(new_mass), 5) AS mass_mean, round(avg(gain), 5) AS gain_mean, CASE WHEN count(*) >= 3 AND stddev_pop(new_mass) > 0 AND stddev_pop(gain) > 0 THEN round(corr(new_mass, gain), 5) END AS pearson,
        CASE WHEN count(*) >= 3 AND stddev_pop(new_mass) > 0 AND stddev_pop(gain) > 0 THEN round(corr(x, y), 5) END AS spearman FROM told GROUP BY 1""",
    "enrichment": f"""WITH {SELECTIONS_SQL}, c AS (SELECT run_id % 7 AS g, metric_id, count(*) AS n FROM selections GROUP BY 1, 2), r AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS rate, sum(n) OVER (PARTITION BY metric_id) / CAST(sum(n) OVER () AS DOUBLE) AS global_rate FROM c)
        SELECT g, metric_id, n, {R('rate')} AS rate, {R('global_rate')} AS global_rate, {R('rate / global_rate')} AS enrichment FROM r""",
    "metric_master": f"""WITH {UTIL_SQL}, t AS (SELECT metric_id, count(*) AS n_top FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS rn FROM utilities) WHERE rn = 1 GROUP BY 1)
        SELECT metric_id, {R('avg(utility)')} AS utility, CAST(max(n_top) AS DOUBLE) AS n_top FROM utilities LEFT JOIN t USING (metric_id) GROUP BY 1""",
    "paired_predictions": f"WITH {RUNS_SQL} SELECT a.dataset_id, a.view_id, a.selected_k AS value_a, b.selected_k AS value_b FROM runs a JOIN runs b USING (dataset_id, view_id) WHERE a.method_name = 'click' AND b.method_name = 'error'",
    "verify_released": f"""WITH {BEST_SQL}, rel AS (SELECT dataset_id, method_name, best_ari + CASE WHEN dataset_id % 10 = 0 THEN 0.01 ELSE 0 END AS released FROM best WHERE best_ari IS NOT NULL AND dataset_id % 9 <> 0)
        SELECT dataset_id, method_name, {R('best_ari')} AS recomputed, {R('released')} AS released FROM best LEFT JOIN rel USING (dataset_id, method_name) WHERE best_ari IS NOT NULL AND coalesce(abs(best_ari - released) > 1e-6, true)""",
    "gap_table": f"WITH {PAIRS_SQL}, {DECLARED_SQL} SELECT gap_type, method, baseline, {GAP_SQL} FROM pairs JOIN declared USING (method, baseline) GROUP BY 1, 2, 3",
    "gap_table_by_family": f"WITH {PAIRS_SQL}, {DECLARED_SQL} SELECT gap_type, family, method, baseline, {GAP_SQL} FROM pairs JOIN declared USING (method, baseline) GROUP BY 1, 2, 3, 4",
    "external_gaps": f"WITH {PAIRS_SQL}, {EXTERNAL_SQL} SELECT gap_type, method, baseline, {GAP_SQL} FROM pairs JOIN declared USING (method, baseline) GROUP BY 1, 2, 3",
    "criterion_table": f"WITH {PAIRS_SQL} SELECT method, baseline, {EFFECT_SQL} FROM pairs WHERE baseline = 'click' GROUP BY 1, 2",
    "paired_t": f"WITH {PAIRS_SQL} SELECT method, baseline, count(*) AS n, {R('avg(delta) / stddev_samp(delta) * sqrt(count(*))')} AS t, CAST(count(*) - 1 AS DOUBLE) AS df, {R('avg(delta) / stddev_samp(delta)')} AS dz FROM pairs GROUP BY 1, 2",
    "hypothesis_statistics": f"""WITH {PAIRS_SQL}, {HYPOTHESES_SQL}, met AS (SELECT hypothesis, test_family, family, method, baseline, delta FROM pairs JOIN declared USING (method, baseline)),
        k AS (SELECT hypothesis, test_family, family, method, baseline, {EFFECT_SQL}, CASE WHEN stddev_samp(delta) > 0 THEN round(avg(delta) / stddev_samp(delta) * sqrt(count(*)), 6) END AS t FROM met GROUP BY 1, 2, 3, 4, 5),
        z AS (SELECT hypothesis, family, delta, rank() OVER w + (count(*) OVER (PARTITION BY hypothesis, family, abs(delta)) - 1) / 2.0 AS r FROM met WHERE delta <> 0 WINDOW w AS (PARTITION BY hypothesis, family ORDER BY abs(delta))),
        s AS (SELECT hypothesis, family, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN delta < 0 THEN r ELSE 0 END) AS w_minus FROM z GROUP BY 1, 2)
        SELECT k.*, {R('w_plus')} AS w_plus, {R('w_minus')} AS w_minus, {R('(w_plus - w_minus) / (w_plus + w_minus)')} AS rank_biserial FROM k LEFT JOIN s USING (hypothesis, family)""",
    "mann_whitney": f"""WITH {BEST_SQL}, r AS (SELECT method_name, family < 4 AS inside, rank() OVER (PARTITION BY method_name ORDER BY best_ari) + (count(*) OVER (PARTITION BY method_name, best_ari) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY method_name, best_ari) AS t FROM best WHERE best_ari IS NOT NULL),
        g AS (SELECT method_name, count(*) FILTER (inside) AS n_in, count(*) FILTER (NOT inside) AS n_out, sum(r) FILTER (inside) - count(*) FILTER (inside) * (count(*) FILTER (inside) + 1) / 2.0 AS u, sum(CAST(t AS DOUBLE) * t - 1) AS ties, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1)
        SELECT method_name, n_in, n_out, {R('u')} AS u, CASE WHEN n_in >= 3 AND n_out >= 3 THEN {R('(abs(u - n_in * n_out / 2.0) - 0.5) / sqrt(n_in * n_out / 12.0 * (n + 1 - ties / (n * (n - 1))))')} END AS z, round(least(1.0, CASE WHEN n_in >= 3 AND n_out >= 3 THEN {NORMAL_P('((abs(u - n_in * n_out / 2.0) - 0.5) / sqrt(n_in * n_out / 12.0 * (n + 1 - ties / (n * (n - 1)))))')} END), 6) AS p_value FROM g""",
    "family_divergence": f"WITH {PICK_SQL} SELECT family, chosen.method_name AS family_selected, {R('mean')} AS family_mean, leader.method_name AS global_selected, chosen.method_name <> leader.method_name AS differs, {R('avg(CAST(chosen.method_name <> leader.method_name AS DOUBLE)) OVER ()')} AS divergence_rate FROM chosen, leader",
    "global_choice_by_family": f"""WITH {PICK_SQL} SELECT family, method_name, count(*) AS n_datasets, count(best_ari) AS n_success, {R('avg(best_ari)')} AS best_ari_mean, {R('median(best_ari)')} AS best_ari_median, {R('stddev_samp(best_ari)')} AS best_ari_std, {R('quantile_cont(best_ari, 0.25)')} AS best_ari_q25,
        {R('quantile_cont(best_ari, 0.75)')} AS best_ari_q75, {R('sum(total_runtime_sec)')} AS total_runtime_sec, {R('quantile_cont(best_runtime_sec, 0.9)')} AS runtime_p90, {R("avg(CAST(best_view = 'x_only' AS DOUBLE))")} AS x_only_share, bool_and(n_success = n_views) AS all_views_ok FROM best JOIN leader USING (method_name) GROUP BY 1, 2""",
    "selection_winners": f"WITH {PICK_SQL} SELECT method_name AS selected, CAST(3 AS BIGINT) AS n FROM leader",
    "greedy_membership": f"""SELECT step, method_name AS added, string_agg(method_name, ';') OVER w AS members, round(gain, 4) AS gain, round((portfolio_mean - first_value(portfolio_mean) OVER w) / nullif(max(portfolio_mean) OVER () - first_value(portfolio_mean) OVER w, 0), 4) AS gain_share
        FROM ({RUN_ORACLES['greedy_portfolio']}) WINDOW w AS (ORDER BY step ROWS UNBOUNDED PRECEDING)""",
    "vbs_problems": f"WITH {VBS_SQL} SELECT 'cost' AS problem, count(*) AS n FROM vbs WHERE dataset_id % 11 = 0 AND portfolio_runtime_sec IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT 'winner', count(*) FROM vbs WHERE dataset_id % 13 = 0 HAVING count(*) > 0",
    "frame_problems": f"WITH {RUNS_SQL}, u AS (SELECT dataset_id, method_name, count(*) AS n FROM runs GROUP BY 1, 2) SELECT 'views' AS problem, count(*) AS n FROM u WHERE n <> 3 HAVING count(*) > 0",
    "capability_matrix": f"WITH {CAPABLE_SQL} SELECT * FROM matrix",
    "preflight": f"""WITH {CAPABLE_SQL}, asked AS (SELECT unnest(['click', 'error', 'absent']) AS method_name), j AS (SELECT * FROM asked LEFT JOIN matrix USING (method_name)),
        r AS (SELECT 'best_view' AS analysis, method_name, {LACKS(comparisons.REQUIREMENTS['best_view'])} AS reason FROM j UNION ALL SELECT 'k_analysis', method_name, {LACKS(comparisons.REQUIREMENTS['k_analysis'])} FROM j UNION ALL SELECT 'vbs', method_name, {LACKS(comparisons.REQUIREMENTS['vbs'])} FROM j)
        SELECT analysis, method_name, reason = '' AS supported, reason FROM r""",
    "comparison_suite": f"WITH {PAIRS_SQL} SELECT 'g' AS gap_type, family, method, baseline, {GAP_SQL} FROM pairs WHERE method = 'click' AND baseline = 'purchase' GROUP BY 2, 3, 4",
    "representative_frame": f"WITH {PICK_SQL} SELECT 'family:' || family AS representative_id, dataset_id, method_name, {R('best_ari')} AS best_ari FROM best JOIN chosen USING (family, method_name)",
    "candidate_sources": f"WITH {UTIL_SQL} SELECT metric_id, metric_id <> 'm_tax' AS included, count(*) AS n FROM utilities GROUP BY 1, 2",
    "ordered_summary": f"WITH {RUNS_SQL} SELECT view_id, method_name, {RUN_BLOCK} FROM runs GROUP BY 1, 2 ORDER BY view_id, ari_mean DESC, method_name",
    "repository_counts": f"WITH {EVALUATIONS_SQL} SELECT 'records' AS table_name, count(*) AS n_rows, count(DISTINCT record_id) AS n_keys FROM records UNION ALL SELECT 'evaluations', count(*), count(DISTINCT (record_id, algorithm)) FROM evaluations UNION ALL SELECT 'failures', count(*), count(DISTINCT record_id) FROM evaluations WHERE NOT valid_result",
    "config_coverage": f"WITH {EVALUATIONS_SQL} SELECT record_id, count(DISTINCT config_id) AS n_configs FROM evaluations WHERE record_id % 7 <> 0 OR config_id < 30 GROUP BY 1 HAVING count(DISTINCT config_id) <> 32",
    "family_coverage": f"""WITH {EVALUATIONS_SQL}, c AS (SELECT records.*, (SELECT count(*) FROM evaluations e WHERE e.record_id = records.record_id AND e.record_id % 6 <> 0) AS e, (SELECT count(*) FROM evaluations e WHERE e.record_id = records.record_id AND NOT valid_result) AS f FROM records)
        SELECT family, count(*) AS n_records, CAST(sum(e) AS BIGINT) AS n_evaluations, CAST(sum(f) AS BIGINT) AS n_failures, count(*) FILTER (e = 0) AS n_empty FROM c GROUP BY 1""",
    "failure_analysis": f"WITH {EVALUATIONS_SQL} SELECT algorithm, CASE WHEN ari > 0.5 THEN 'late' ELSE 'early' END AS reason, count(*) AS n, {R('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share FROM evaluations WHERE NOT valid_result GROUP BY 1, 2",
    "split_summary": f"WITH {PARTS_SQL} SELECT split_id, count(*) AS n_rows, count(DISTINCT dataset_id) AS n_datasets, count(DISTINCT family) AS n_families, count(DISTINCT subfamily) AS n_subfamilies FROM parts GROUP BY 1",
    "keep_splits": f"WITH {PARTS_SQL} SELECT dataset_id, split_id FROM parts WHERE split_id IN (2, 5)",
    "dynamic_k_distribution": f"""WITH {UTIL_SQL}, rel AS (SELECT dataset_id, count(*) FILTER (greatest(0.0, least(1.0, utility)) >= 0.92 * top) AS r FROM (SELECT *, max(greatest(0.0, least(1.0, utility))) OVER (PARTITION BY dataset_id) AS top FROM utilities) GROUP BY 1)
        SELECT CAST(CASE WHEN r <= 5 THEN r ELSE ceil((r + 5) / 2.0) END AS INTEGER) AS k, count(*) AS n FROM rel GROUP BY 1""",
    "job_counts": f"WITH {PARTS_SQL} SELECT subfamily, CAST(cluster_count AS DOUBLE) AS cluster_count, count(*) AS n_jobs, CAST(grouping(subfamily) * 2 + grouping(cluster_count) AS BIGINT) AS level FROM parts GROUP BY ROLLUP (subfamily, cluster_count)",
    "best_algorithm": f"WITH {EVALUATIONS_SQL} SELECT record_id, algorithm AS best_algorithm, config_id AS best_config_id, {R('ari')} AS best_ari, family, subfamily FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ari DESC, config_id) AS rn FROM evaluations WHERE valid_result) JOIN records USING (record_id) WHERE rn = 1",
    "ari_regression_rows": f"WITH {EVALUATIONS_SQL} SELECT record_id, config_id, algorithm, {R('ari')} AS ari, {R('objective')} AS objective, family, subfamily FROM evaluations JOIN records USING (record_id) WHERE valid_result AND ari IS NOT NULL",
    "slate_problems": f"WITH {EVALUATIONS_SQL} SELECT record_id, 'count' AS problem FROM evaluations WHERE record_id % 7 <> 0 OR config_id < 30 GROUP BY 1 HAVING count(*) <> 32",
    "eligible_trials": f"WITH {SCORED_SQL} SELECT dataset_id, candidate FROM scored WHERE valid AND objective IS NOT NULL AND candidate % 4 >= 2",
    "warmstart": f"WITH {SCORED_SQL} SELECT dataset_id, candidate, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY round(ari, 9) DESC NULLS LAST, candidate) AS INTEGER) AS position FROM scored",
    "metric_key": "SELECT event_id, CASE event_type WHEN 'click' THEN 'Davies Bouldin' WHEN 'view' THEN 'm_tax' WHEN 'error' THEN ' S-Dbw ' WHEN 'signup' THEN 'nothing' END AS name, CASE event_type WHEN 'click' THEN 'davies_bouldin' WHEN 'view' THEN 'm_tax' WHEN 'error' THEN 's_dbw' END AS key FROM events",
    "top1_scores": f"WITH {SUITE_SQL} SELECT dataset_id, hit = 1 AS hit, rank_distance, {R('utility_error')} AS utility_error, {R('calibration_error')} AS calibration_error FROM one",
    "top_k_scores": f"WITH {SUITE_SQL} SELECT dataset_id, {R('overlap')} AS overlap, {R('ordered')} AS ordered, {R('jaccard')} AS jaccard, {R('abs_error')} AS abs_error, {R('squared_error')} AS squared_error, n_union FROM tops",
    "rank_scores": f"WITH {SUITE_SQL} SELECT dataset_id, {R('spearman')} AS spearman, {R('displacement_mean')} AS displacement_mean, {R('displacement_median')} AS displacement_median, displacement_max, {R('pairwise')} AS pairwise, {R('kendall')} AS kendall FROM ranked",
    "score_suite": f"WITH {SUITE_SQL} SELECT score, round(value, 5) AS value FROM ({SCORES_SQL})",
    "dynamic_k_scores": f"""WITH {SIZES_SQL} SELECT count(*) AS n, {R('avg(CAST(k_predicted = k_true AS DOUBLE))')} AS exact, {R('avg(CAST(abs(k_predicted - k_true) <= 1 AS DOUBLE))')} AS within_1, {R('avg(abs(k_predicted - k_true))')} AS mae, {R('sqrt(avg((k_predicted - k_true) ** 2))')} AS rmse, {R('avg(k_predicted - k_true)')} AS bias,
        {R('avg(CAST(k_predicted < k_true AS DOUBLE))')} AS under, {R('avg(CAST(k_predicted > k_true AS DOUBLE))')} AS over, {R('avg(k_true)')} AS k_true_mean, {R('avg(k_predicted)')} AS k_predicted_mean FROM sizes""",
    "dynamic_k_confusion": f"WITH {SIZES_SQL} SELECT t AS k_true, p AS k_predicted, (SELECT count(*) FROM sizes WHERE k_true = t AND k_predicted = p) AS n FROM (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS t), (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS p)",
    "resolve_weights": f"""WITH {UTIL_SQL}, sel AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS position FROM utilities), e AS (SELECT *, exp((utility - max(utility) OVER (PARTITION BY dataset_id)) / 0.5) AS e FROM sel WHERE position <= 3)
        SELECT dataset_id, metric_id, {R('e / sum(e) OVER (PARTITION BY dataset_id)')} AS weight, CAST(position AS INTEGER) AS position FROM e""",
    "resolve_weights_dynamic": f"""WITH {UTIL_SQL}, own AS (SELECT *, greatest(0.0, least(1.0, utility)) AS u FROM utilities WHERE metric_id <> 'm_discount'), r AS (SELECT dataset_id, count(*) FILTER (u >= 0.92 * top) AS k FROM (SELECT *, max(u) OVER (PARTITION BY dataset_id) AS top FROM own) GROUP BY 1),
        sel AS (SELECT own.*, k, row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS position FROM own JOIN r USING (dataset_id)), e AS (SELECT *, greatest(0.0, utility) AS e FROM sel WHERE position <= k)
        SELECT dataset_id, metric_id, round(CASE WHEN sum(e) OVER w > 0 THEN e / sum(e) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS weight, CAST(position AS INTEGER) AS position FROM e WINDOW w AS (PARTITION BY dataset_id)""",
    "weights_with_fallback": f"""WITH {UTIL_SQL} SELECT dataset_id, metric_id, 1.0 AS weight, false AS used_fallback FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS rn FROM utilities WHERE dataset_id % 3 <> 0) WHERE rn = 1
        UNION ALL SELECT dataset_id, m, w, true FROM (SELECT DISTINCT dataset_id FROM utilities WHERE dataset_id % 3 = 0), (VALUES ('silhouette', 0.6), ('s_dbw', 0.4)) AS f(m, w)""",
    "neighbour_grid": """SELECT family, printf('n%03d__%s__%s__%s', n, s, d, w) AS config_id, CAST(n AS INTEGER) AS n_neighbors, s AS scaler, d AS distance, w AS weighting FROM (SELECT DISTINCT p_brand AS family FROM part), (SELECT unnest([1, 2, 3, 5, 7, 10, 15, 20, 30, 50, 75, 100]) AS n), (SELECT unnest(['standard', 'robust']) AS s), (SELECT unnest(['euclidean', 'cosine']) AS d), (SELECT unnest(['uniform', 'inverse_distance']) AS w)""",
    "grid_predictions": f"""WITH {GRID_SQL}, p AS (SELECT n_neighbors, query_id, metric_id, avg(utility) AS u, sum(w * utility) / sum(w) AS i FROM met JOIN sized ON position <= n_neighbors GROUP BY 1, 2, 3)
        SELECT CAST(n_neighbors AS INTEGER) AS n_neighbors, 'uniform' AS weighting, query_id, metric_id, {R('greatest(0.0, least(1.0, u))')} AS utility FROM p UNION ALL SELECT CAST(n_neighbors AS INTEGER), 'inverse_distance', query_id, metric_id, {R('greatest(0.0, least(1.0, i))')} FROM p""",
    "fold_composite": f"""WITH {TRIALS_SQL}, s AS (SELECT dataset_id % 3 AS fold, metric_id, round(avg(abs(score - ari)), 6) AS mae, round(avg(score), 6) AS hit, round(max(score), 6) AS r FROM trials GROUP BY 1, 2),
        p AS (SELECT fold, metric_id, (rank() OVER (PARTITION BY fold ORDER BY mae DESC) + (count(*) OVER (PARTITION BY fold, mae) - 1) / 2.0) / count(*) OVER (PARTITION BY fold) AS m, (rank() OVER (PARTITION BY fold ORDER BY hit) + (count(*) OVER (PARTITION BY fold, hit) - 1) / 2.0) / count(*) OVER (PARTITION BY fold) AS h,
            (rank() OVER (PARTITION BY fold ORDER BY r DESC) + (count(*) OVER (PARTITION BY fold, r) - 1) / 2.0) / count(*) OVER (PARTITION BY fold) AS k FROM s)
        SELECT fold, metric_id, {R('m')} AS score_errors, {R('(h + k) / 2')} AS score_tops, {R('(m + (h + k) / 2) / 2')} AS composite FROM p""",
    "selector_scores": f"""WITH {RUNS_SQL}, p AS (SELECT dataset_id, view_id, method_name, ari FROM runs WHERE ari IS NOT NULL),
        own AS (SELECT avg(a) AS s FROM (SELECT max(ari) AS a FROM p WHERE method_name = 'click' GROUP BY dataset_id)), best AS (SELECT avg(a) AS o FROM (SELECT max(ari) AS a FROM p GROUP BY dataset_id)),
        m AS (SELECT method_name, avg(a) AS m FROM (SELECT dataset_id, method_name, max(ari) AS a FROM p GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), one AS (SELECT avg(a) AS b FROM (SELECT max(ari) AS a FROM p JOIN m USING (method_name) GROUP BY dataset_id)),
        v AS (SELECT view_id, method_name FROM (SELECT view_id, method_name, avg(ari) AS m FROM p GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY m DESC, method_name) = 1), by_view AS (SELECT avg(a) AS w FROM (SELECT max(ari) AS a FROM p JOIN v USING (view_id, method_name) GROUP BY dataset_id))
        SELECT {R('s')} AS selector, {R('b')} AS best_single, {R('w')} AS best_by_view, {R('o')} AS oracle, {R('(s - b) / (o - b)')} AS recovery_single, {R('(s - w) / (o - w)')} AS recovery_view FROM own, best, one, by_view""",
    "nearest_label": f"""WITH {EVALUATIONS_SQL}, u AS (SELECT dataset_id AS record_id, metric_id, round(avg(score), 6) AS v FROM trials GROUP BY 1, 2), f AS (SELECT record_id, coalesce(max(v) FILTER (metric_id = 'm_price'), 0) AS a, coalesce(max(v) FILTER (metric_id = 'm_quantity'), 0) AS b, coalesce(max(v) FILTER (metric_id = 'm_tax'), 0) AS c FROM u GROUP BY 1),
        l AS (SELECT record_id, algorithm AS best_algorithm FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ari DESC, config_id) AS rn FROM evaluations WHERE valid_result) WHERE rn = 1),
        d AS (SELECT q.record_id, r.record_id AS neighbour_id, sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2 + (q.c - r.c) ** 2) AS distance FROM f q JOIN f r ON q.record_id <> r.record_id WHERE r.record_id IN (SELECT record_id FROM l))
        SELECT d.record_id, neighbour_id, {R('distance')} AS distance, best_algorithm FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY distance, neighbour_id) AS rn FROM d) d JOIN l ON l.record_id = neighbour_id WHERE rn = 1""",
    "within_patience": f"""WITH {SCORED_SQL}, a AS (SELECT *, row_number() OVER w AS n, coalesce(coalesce(objective, -1e12) > max(coalesce(objective, -1e12)) OVER (PARTITION BY dataset_id ORDER BY candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM scored WINDOW w AS (PARTITION BY dataset_id ORDER BY candidate)),
        b AS (SELECT *, n - max(CASE WHEN better THEN n END) OVER (PARTITION BY dataset_id ORDER BY n) AS since FROM a) SELECT dataset_id, candidate FROM (SELECT *, min(CASE WHEN since >= 3 THEN n END) OVER (PARTITION BY dataset_id) AS stop FROM b) WHERE stop IS NULL OR n <= stop""",
    "config_block": f"WITH {SCORED_SQL} SELECT dataset_id, candidate, CAST(k AS DOUBLE) AS algo__kmeans, CAST(NOT k AS DOUBLE) AS algo__hdbscan_constrained, CASE WHEN k THEN 0.0 ELSE 4.0 END AS cfg__target_k, CAST(NOT k AS DOUBLE) AS cfgmask__target_k, CASE WHEN k THEN 3.0 ELSE 0.0 END AS cfg__n_clusters, CAST(k AS DOUBLE) AS cfgmask__n_clusters, 0.0 AS cfgmask__linkage FROM (SELECT *, candidate % 2 = 0 AS k FROM scored)",
    "hidden_values": f"WITH {UTIL_SQL} SELECT metric_id, count(*) AS n FROM utilities WHERE metric_id = 'm_tax' AND dataset_id % 3 = 0 AND utility <> 0 GROUP BY 1",
    "policy_rows": f"WITH {RUNS_SQL} SELECT dataset_id, view_id, round(avg(runtime_sec), 6) AS runtime, round(max(selected_k / 5.0) FILTER (method_name = 'click'), 6) AS u_click, round(max(ari) FILTER (method_name = 'view'), 6) AS p_view, CAST(count(*) AS INTEGER) AS n FROM runs WHERE ari IS NOT NULL GROUP BY 1, 2",
    "candidate_trace": f"WITH {SCORED_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY objective DESC NULLS LAST, candidate) AS a, row_number() OVER (PARTITION BY dataset_id ORDER BY -objective DESC NULLS LAST, candidate) AS b FROM scored WHERE valid) SELECT dataset_id, 'objective' AS arm, candidate FROM v WHERE a = 1 UNION ALL SELECT dataset_id, 'negated', candidate FROM v WHERE b = 1",
    "cloud_structure": f"WITH {POINTS_SQL} SELECT dataset_id, y_true, count(*) AS n, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("x", "y") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + ", round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY dataset_id) AS DOUBLE), 6) AS share FROM points GROUP BY 1, 2",
    "wide_trials": f"""WITH {TRIALS_SQL} SELECT dataset_id, candidate, round(max(score) FILTER (metric_id = 'm_price'), 7) AS m_price_w0_5, round(max(least(1.0, score)) FILTER (metric_id = 'm_price'), 7) AS m_price_norm, round(max(score) FILTER (metric_id = 'm_tax'), 7) AS m_tax_w1_0, round(max(least(1.0, score)) FILTER (metric_id = 'm_tax'), 7) AS m_tax_norm FROM trials GROUP BY 1, 2""",
    "column_roles": f"WITH {UTIL_SQL} SELECT dataset_id % 4 AS split_id, count(*) AS n, CAST(sum(dataset_id) AS DOUBLE) AS a, {R('avg(utility)')} AS u FROM utilities WHERE metric_id = 'm_price' GROUP BY 1",
    "training_rows": f"WITH {UTIL_SQL} SELECT dataset_id, 'x_only' AS view_id, 'f' AS family, 's' AS subfamily, dataset_id * 2 AS a, {R("max(utility) FILTER (metric_id = 'm_price')")} AS utility__m_price, {R("max(utility) FILTER (metric_id = 'm_tax')")} AS utility__m_tax FROM utilities WHERE dataset_id % 5 <> 0 GROUP BY 1",
    "missing_utilities": f"WITH {UTIL_SQL} SELECT DISTINCT 'f' AS family, 's' AS subfamily, dataset_id, 'x_only' AS view_id, 'utility_vector.json missing' AS reason FROM utilities WHERE dataset_id % 5 = 0",
    "shape_counts": "SELECT shape, CAST(50 * count(*) AS BIGINT) AS n, count(*) AS clouds FROM supplier JOIN (VALUES " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(sorted(shapes.SHAPES))) + f") AS v(k, shape) ON s_suppkey % {len(shapes.SHAPES)} = k GROUP BY shape",
}
