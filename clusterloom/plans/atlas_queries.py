"""Queries over utilities of indices with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import atlas
from .projections import UTILITIES_SQL, rounded, trial_metrics, utilities

NEW = ("m_tax", "m_discount")


def _catalog(u):
    return u.select("metric_id").distinct().withColumn("grp", F.when(F.col("metric_id").isin(*NEW), "new").otherwise("old"))


def _grouped(s, d):
    return utilities(s, d).withColumn("family", F.col("dataset_id") % 7)


def _predicted(s, d):
    """A stand-in prediction: the same profile, shifted by the index's name length."""
    return utilities(s, d).withColumn("utility", F.round(F.col("utility") * 0.5 + F.length("metric_id") / 40.0, 6))


def _sources(s, d):
    u = utilities(s, d)
    return u.withColumn("source", F.lit("knn")).unionByName(_predicted(s, d).withColumn("source", F.lit("mlp")))


def _candidates(s, d):
    return trial_metrics(s, d).select("dataset_id", "candidate", "ari", "metric_id", F.round(F.least(F.lit(1.0), F.col("score")), 9).alias("norm"))


RANKED_SQL = UTILITIES_SQL + """,
ranked AS (SELECT dataset_id, dataset_id % 7 AS family, metric_id, utility, rank() OVER (PARTITION BY dataset_id ORDER BY utility DESC) + (count(*) OVER (PARTITION BY dataset_id, utility) - 1) / 2.0 AS rank,
    row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS position FROM utilities),
predicted AS (SELECT dataset_id, metric_id, round(utility * 0.5 + length(metric_id) / 40.0, 6) AS utility FROM utilities)"""
GLOBAL = "count(*) AS n, round(avg(utility), 6) AS utility_mean, round(median(utility), 6) AS utility_median, round(stddev_samp(utility), 6) AS utility_std, round(avg(rank), 6) AS rank_mean, round(avg(CAST(position = 1 AS DOUBLE)), 6) AS first_share, round(avg(CAST(position <= 2 AS DOUBLE)), 6) AS top_share"
UPLIFT = """t AS (SELECT family, metric_id, sum(utility) AS s, count(*) AS n FROM ranked GROUP BY 1, 2),
u AS (SELECT family, metric_id, n, s / n AS inside, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS outside FROM t WINDOW w AS (PARTITION BY metric_id))"""
BREADTH = """m AS (SELECT family, metric_id, avg(utility) AS u FROM ranked GROUP BY 1, 2),
b AS (SELECT family, metric_id, u / sum(u) OVER (PARTITION BY metric_id) AS p, row_number() OVER (PARTITION BY family ORDER BY u DESC, metric_id) AS position FROM m),
core AS (SELECT metric_id, count(*) AS n_groups, count(*) FILTER (position <= 2) AS n_top, -sum(p * ln(p)) / ln(count(*)) AS evenness FROM b GROUP BY 1)"""

QUERIES = {
    "global_utility": lambda s, d: rounded(atlas.global_utility(utilities(s, d))),
    "family_utility": lambda s, d: rounded(atlas.global_utility(_grouped(s, d), keys=["family"]), 9),
    "group_contrast": lambda s, d: rounded(atlas.group_contrast(utilities(s, d), _catalog(utilities(s, d)), "grp")),
    "utility_uplift": lambda s, d: rounded(atlas.uplift(_grouped(s, d), "family")),
    "core_breadth": lambda s, d: rounded(atlas.core_breadth(_grouped(s, d), "family")),
    "specialists": lambda s, d: rounded(atlas.specialists(atlas.uplift(_grouped(s, d), "family"), atlas.core_breadth(_grouped(s, d), "family"))),
    "complementarity": lambda s, d: rounded(atlas.complementarity(utilities(s, d), NEW)),
    "utility_alignment": lambda s, d: rounded(atlas.alignment(utilities(s, d), _predicted(s, d))),
    "top_k_recall": lambda s, d: rounded(atlas.top_k_recall(utilities(s, d), _predicted(s, d))),
    "policy_replay": lambda s, d: rounded(atlas.replay(_sources(s, d), _candidates(s, d))),
}

ORACLE_SQL = {
    "global_utility": f"WITH {RANKED_SQL} SELECT metric_id, {GLOBAL} FROM ranked GROUP BY 1",
    "family_utility": f"WITH {RANKED_SQL} SELECT family, metric_id, {GLOBAL.replace(', 6)', ', 9)')} FROM ranked GROUP BY 1, 2",
    "group_contrast": f"""WITH {RANKED_SQL}, g AS (SELECT *, CASE WHEN metric_id IN ('m_tax', 'm_discount') THEN 'new' ELSE 'old' END AS grp FROM ranked),
        p AS (SELECT g.dataset_id, x.grp, avg(utility) FILTER (g.grp = x.grp) AS i, avg(utility) FILTER (g.grp <> x.grp) AS o FROM g, (SELECT unnest(['new', 'old']) AS grp) x GROUP BY 1, 2)
        SELECT grp, count(*) AS n, round(avg(i), 6) AS inside_mean, round(avg(i - o), 6) AS contrast_mean, round(median(i - o), 6) AS contrast_median, round(avg(CAST(i - o > 0 AS DOUBLE)), 6) AS positive_share FROM p GROUP BY 1""",
    "utility_uplift": f"WITH {RANKED_SQL}, {UPLIFT} SELECT family, metric_id, n, round(inside, 6) AS inside, round(outside, 6) AS outside, round(inside - outside, 6) AS uplift FROM u",
    "core_breadth": f"WITH {RANKED_SQL}, {BREADTH} SELECT metric_id, n_groups, n_top, round(evenness, 6) AS evenness FROM core",
    "specialists": f"WITH {RANKED_SQL}, {UPLIFT}, {BREADTH} SELECT family, metric_id, n, round(inside, 6) AS inside, round(outside, 6) AS outside, round(inside - outside, 6) AS uplift FROM u WHERE inside - outside > 0 AND metric_id IN (SELECT metric_id FROM core WHERE n_top <= 3)",
    "complementarity": f"""WITH {RANKED_SQL}, x AS (SELECT *, max(CASE WHEN metric_id NOT IN ('m_tax', 'm_discount') THEN utility END) OVER (PARTITION BY dataset_id) AS best FROM ranked)
        SELECT metric_id, count(*) AS n, round(avg(utility - best), 6) AS gain_mean, round(avg(CAST(utility > best AS DOUBLE)), 6) AS win_share, round(avg(greatest(utility, best)), 6) AS ceiling_mean FROM x WHERE metric_id IN ('m_tax', 'm_discount') GROUP BY 1""",
    "utility_alignment": f"""WITH {RANKED_SQL}, r AS (SELECT a.dataset_id, rank() OVER (PARTITION BY a.dataset_id ORDER BY a.utility) + (count(*) OVER (PARTITION BY a.dataset_id, a.utility) - 1) / 2.0 AS x, rank() OVER (PARTITION BY a.dataset_id ORDER BY p.utility) + (count(*) OVER (PARTITION BY a.dataset_id, p.utility) - 1) / 2.0 AS y FROM utilities a JOIN predicted p USING (dataset_id, metric_id)),
        c AS (SELECT dataset_id, corr(x, y) AS rho FROM r GROUP BY 1) SELECT count(rho) AS n, round(avg(rho), 6) AS rho_mean, round(median(rho), 6) AS rho_median FROM c""",
    "top_k_recall": f"""WITH {RANKED_SQL}, p AS (SELECT dataset_id, metric_id, row_number() OVER (PARTITION BY dataset_id ORDER BY utility DESC, metric_id) AS b FROM predicted)
        SELECT count(DISTINCT dataset_id) AS n_datasets, round(count(*) FILTER (position <= 2 AND b <= 2) / CAST(count(*) FILTER (position <= 2) AS DOUBLE), 6) AS recall FROM ranked JOIN p USING (dataset_id, metric_id)""",
    "policy_replay": f"""WITH {RANKED_SQL}, src AS (SELECT 'knn' AS source, dataset_id, metric_id, utility FROM utilities UNION ALL SELECT 'mlp', dataset_id, metric_id, utility FROM predicted),
        o AS (SELECT *, row_number() OVER (PARTITION BY source, dataset_id ORDER BY utility DESC, metric_id) AS rn, greatest(0.0, least(1.0, utility)) AS u FROM src),
        rel AS (SELECT source, dataset_id, count(*) FILTER (u >= 0.92 * top) AS k FROM (SELECT *, max(u) OVER (PARTITION BY source, dataset_id) AS top FROM o) GROUP BY 1, 2),
        ch AS (SELECT source, dataset_id, metric_id, utility, '1' AS size FROM o WHERE rn <= 1 UNION ALL SELECT source, dataset_id, metric_id, utility, '3' FROM o WHERE rn <= 3 UNION ALL SELECT source, dataset_id, metric_id, utility, 'dynamic' FROM o JOIN rel USING (source, dataset_id) WHERE rn <= k),
        w AS (SELECT source, size, 'raw' AS weighting, dataset_id, metric_id, CASE WHEN sum(greatest(utility, 0)) OVER q > 0 THEN greatest(utility, 0) / sum(greatest(utility, 0)) OVER q ELSE 1.0 / count(*) OVER q END AS weight FROM ch WINDOW q AS (PARTITION BY source, size, dataset_id)
            UNION ALL SELECT source, size, 'softmax', dataset_id, metric_id, e / sum(e) OVER (PARTITION BY source, size, dataset_id) FROM (SELECT *, exp((utility - max(utility) OVER (PARTITION BY source, size, dataset_id)) / 0.1) AS e FROM ch)),
        j AS (SELECT source, size, weighting, t.dataset_id, candidate, ari, round(sum(weight * round(least(1.0, score), 9)), 9) AS objective FROM w JOIN trials t ON t.dataset_id = w.dataset_id AND t.metric_id = w.metric_id GROUP BY 1, 2, 3, 4, 5, 6),
        b AS (SELECT *, max(objective) OVER (PARTITION BY source, size, weighting, dataset_id) AS top, max(ari) OVER (PARTITION BY source, size, weighting, dataset_id) AS ceiling FROM j)
        SELECT source, size, weighting, dataset_id, min(candidate) AS candidate, round(arg_min(ari, candidate), 6) AS ari, round(max(ceiling) - arg_min(ari, candidate), 6) AS regret FROM b WHERE objective >= top - 1e-12 GROUP BY 1, 2, 3, 4""",
}
