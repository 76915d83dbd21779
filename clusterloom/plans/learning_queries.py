"""Queries of the learned predictors and their feature rows, with their DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, metafeatures, models, predictions, splits
from .projections import RUNS_SQL, UTILITIES_SQL, rounded, runs, table, utilities

METRICS = ("m_discount", "m_price", "m_quantity", "m_tax")


def _components(s, d, n):
    return table(s, d, "embeddings").select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("kind"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).select("vec_id", "kind", "e", *(F.col("e")[i].alias(f"e{i}") for i in range(n)))


def _network(s, d):
    """Four targets in two heads, learned from eight components; the targets are squashed components."""
    squash = lambda i: 1 / (1 + F.exp(-4 * F.col("e")[i]))
    rows = _components(s, d, 0).select("vec_id", F.slice("e", 1, 8).alias("features"), F.array(*(squash(i) for i in range(4))).alias("targets"))
    nets = [models.fit_utility_net(models.hash_folds(rows, "vec_id", 2).filter(F.col("fold") == f), [[0, 1], [2, 3]], epochs=15) for f in range(2)]
    return models.predict_utility_net(rows, nets).select("vec_id", *(F.col("predicted")[i].alias(f"p{i}") for i in range(4)))


def _ari(s, d):
    rows = _components(s, d, 6).withColumn("ari", 1 / (1 + F.exp(-4 * F.col("e")[7])))
    columns = [f"e{i}" for i in range(6)]
    return learning.fit_ari_network(rows, columns, epochs=15, most=20_000)(rows).select("vec_id", "predicted_ari")


def _classifier(s, d):
    rows = _components(s, d, 8)
    return learning.fit_index_classifier(rows, [f"e{i}" for i in range(8)], "kind", trees=20)(rows).select("vec_id", "kind", "predicted_kind")


def _profiles(s, d):
    at = [F.max(F.when(F.col("metric_id") == m, F.col("utility"))) for m in METRICS]
    return utilities(s, d).groupBy("dataset_id").agg(F.array(*at).alias("features"))


def _out_of_fold(s, d):
    own = _profiles(s, d)
    folds = own.select("dataset_id", (F.col("dataset_id") % 3).cast("int").alias("fold"))
    return predictions.out_of_fold(folds, own, utilities(s, d), 5)


def _rerankers(s, d):
    named = [(f"p{i:02d}", r["reranker_id"], r["weighting"]) for i, r in enumerate(predictions.policy_rerankers([{"policy_id": i, "source": a, "top_k": k, "weighting": w} for i, (a, k, w) in enumerate(splits.policies())]))]
    listed = s.createDataFrame(named, "policy_id string, reranker_id string, weighting string")
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("dataset_id")).join(F.broadcast(listed)).groupBy("reranker_id").agg(F.count("*").alias("n"), F.countDistinct("policy_id").alias("policies"), F.min("policy_id").alias("first"))


def _policy_features(s, d):
    own = runs(s, d).select("dataset_id", "method_name", "view_id", "runtime_sec", "selected_k", "ari")
    return own.select("dataset_id", "method_name", *predictions.policy_features(["runtime_sec", "selected_k"], ["ari"], "META_UTILITIES"))


def _online(s, d):
    own = runs(s, d).withColumns({"source": F.when(F.col("family") % 2 == 0, "mlp").otherwise("knn"), "k_mode": F.when(F.col("selected_k") == 2, "top1").when(F.col("selected_k") == 3, "top3").when(F.col("selected_k") == 4, "top10").otherwise("dynamic"), "actual_k": F.col("selected_k") + 1})
    blocks = learning.online_row(partition=["selected_k", "runtime_sec"], utilities=["ari"])
    return own.select("dataset_id", "method_name", *(c.alias("actual_k") if i == 12 else c for i, c in enumerate(blocks)))


def _complete(s, d):
    cells = runs(s, d).select("dataset_id", "method_name", "view_id", F.when(F.col("family") > 3, F.col("status")).alias("status"), "ari", F.when(F.col("selected_k") > 2, F.col("selected_k")).alias("selected_k"), "runtime_sec", F.when(F.col("family") > 5, F.col("view_rank") > 0).alias("later"))
    return metafeatures.complete(cells)


QUERIES = {
    "utility_network": lambda s, d: rounded(_network(s, d), 4),
    "ari_network": lambda s, d: rounded(_ari(s, d), 4),
    "index_classifier": _classifier,
    "out_of_fold": lambda s, d: rounded(_out_of_fold(s, d)),
    "policy_rerankers": _rerankers,
    "policy_features": _policy_features,
    "online_row": _online,
    "complete_record": _complete,
}

HOT = lambda c, values, name: ", ".join(f"CAST({c} = '{v}' AS DOUBLE) AS {name}__{v}" for v in values)
VIEWS = HOT("view_id", learning.VIEWS, "view")
ORACLE_SQL = {
    "out_of_fold": f"""WITH {UTILITIES_SQL},
p AS (SELECT dataset_id, dataset_id % 3 AS fold, {", ".join(f"max(utility) FILTER (metric_id = '{m}') AS {m}" for m in METRICS)} FROM utilities GROUP BY 1),
d AS (SELECT a.dataset_id, CAST(a.fold AS INTEGER) AS fold, b.dataset_id AS other, sqrt({" + ".join(f"(a.{m} - b.{m}) ** 2" for m in METRICS)}) AS d FROM p a JOIN p b ON a.fold <> b.fold),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY d, other) <= 5),
w AS (SELECT *, CASE WHEN min(d) OVER (PARTITION BY dataset_id) <= 1e-12 THEN CAST(d <= 1e-12 AS DOUBLE) ELSE 1 / (d + 1e-9) END AS w FROM near)
SELECT w.dataset_id, metric_id, round(greatest(0, least(1, sum(w * utility) / sum(w))), 6) AS utility, fold FROM w JOIN utilities u ON u.dataset_id = w.other GROUP BY 1, 2, 4""",
    "policy_rerankers": """WITH p AS (SELECT printf('p%02d', row_number() OVER (ORDER BY i, j, w) - 1) AS policy_id, upper(a || '_' || CASE k WHEN 'dynamic' THEN k ELSE 'top' || k END) AS reranker_id
    FROM (VALUES (0, 'mlp'), (1, 'knn')) AS s(i, a), (VALUES (0, '1'), (1, '3'), (2, '5'), (3, '10'), (4, 'dynamic')) AS t(j, k), (VALUES (0), (1)) AS x(w))
SELECT reranker_id, count(*) AS n, count(DISTINCT policy_id) AS policies, min(policy_id) AS first FROM supplier, p GROUP BY 1""",
    "policy_features": f"WITH {RUNS_SQL} SELECT dataset_id, method_name, runtime_sec, selected_k, ari, {VIEWS} FROM runs",
    "online_row": f"""WITH {RUNS_SQL}, own AS (SELECT *, CASE family % 2 WHEN 0 THEN 'mlp' ELSE 'knn' END AS source, CASE selected_k WHEN 2 THEN 'top1' WHEN 3 THEN 'top3' WHEN 4 THEN 'top10' ELSE 'dynamic' END AS k_mode FROM runs)
SELECT dataset_id, method_name, {VIEWS}, selected_k, runtime_sec, {HOT("source", ("mlp", "knn"), "source")}, {HOT("k_mode", ("top1", "top3", "top5", "top10", "dynamic"), "k_mode")}, CAST(selected_k + 1 AS DOUBLE) AS actual_k, ari FROM own""",
    "complete_record": f"""WITH {RUNS_SQL} SELECT dataset_id, method_name, view_id, CASE WHEN family > 3 THEN status ELSE 'unknown' END AS status, coalesce(ari, 0.0) AS ari,
    CASE WHEN selected_k > 2 THEN selected_k ELSE -1 END AS selected_k, coalesce(runtime_sec, 0.0) AS runtime_sec, CASE WHEN family > 5 THEN view_rank > 0 ELSE false END AS later FROM runs""",
}
