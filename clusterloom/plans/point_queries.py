"""Queries over point clouds, partitions, neighbours, splits and sources with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, boosting, density, descriptors, indices, metafeatures, models, neighbours, patterns, rasters, search, sequential, shapes, splits
from ..sources import clouds
from .projections import POINTS_SQL, TRIALS_SQL, UTILITIES_SQL, points, rounded, table, trial_metrics, utilities

KEY = ["dataset_id"]


def _labels(s, d):
    return points(s, d).select("dataset_id", "point_id", "y_true", "y_pred")


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _neighbours(s, d, k=5, asked="true"):
    return neighbours.knn_join(_vectors(s, d).filter(asked), _vectors(s, d), k, "vec_id", "v")


def _small_clouds(s, d):
    """Clouds of 64 vectors, as many as the table has."""
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("dataset_id"), F.col("vec_id").alias("point_id"), x.alias("x"), y.alias("y"))


def _partitions(s, d):
    """Two partitions of each cloud: the quadrants, and the sides of x."""
    side = F.when(F.col("label") == -1, -1).otherwise((F.col("x") >= 0).cast("int"))
    both = F.explode(F.array(F.struct(F.lit(1).alias("candidate"), F.col("label").alias("label")), F.struct(F.lit(2).alias("candidate"), side.alias("label")))).alias("p")
    return points(s, d).select("dataset_id", "point_id", "x", "y", both).select("dataset_id", "point_id", "x", "y", "p.*")


def _boosted(s, d):
    """The first component of each vector, predicted from the next eight, of which every eleventh row lacks one."""
    cells = [F.when(F.col("vec_id") % 11 != i, F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(1, 9)]
    rows = table(s, d, "embeddings").select("vec_id", *cells, F.col("embedding")[0].cast("double").alias("target"))
    model = boosting.fit(rows, [f"e{i}" for i in range(1, 9)], "target")
    return model.transform(rows).select("vec_id", "predicted", "target")


def _index(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("dataset_id"), F.col("p_type").alias("stratum"))


def _slates(s, d):
    return trial_metrics(s, d).filter("metric_id = 'm_tax'").select("dataset_id", "candidate", "ari", "valid")


def _jobs(s, d):
    plan = '{"components": [{"id": "a", "shape": "blob", "n": 60}, {"id": "b", "shape": "ring", "n": 90, "parents": ["a"]}], "perturb": {"dropout": 0.1, "contamination": 0.05}}'
    return table(s, d, "nation").select(F.col("n_nationkey").alias("dataset_id"), splits.derive_seed(F.lit(42), F.col("n_nationkey")).alias("seed"), F.lit(plan).alias("plan"))


OWN = POINTS_SQL + """,
own AS (SELECT * FROM points WHERE label <> -1),
cl AS (SELECT dataset_id, label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, (var_pop(x) + var_pop(y)) * count(*) AS ss, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM own GROUP BY 1, 2),
far AS (SELECT own.dataset_id, label, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM own JOIN cl USING (dataset_id, label)),
gaps AS (SELECT a.dataset_id, a.label, b.label AS lb, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS gap FROM cl a JOIN cl b ON a.dataset_id = b.dataset_id AND a.label <> b.label)"""
CELLS = POINTS_SQL + """,
cell AS (SELECT dataset_id, y_true, y_pred, count(*) AS n FROM points GROUP BY 1, 2, 3),
m AS (SELECT *, sum(n) OVER (PARTITION BY dataset_id, y_true) AS a, sum(n) OVER (PARTITION BY dataset_id, y_pred) AS b, sum(n) OVER (PARTITION BY dataset_id) AS t, max(n) OVER (PARTITION BY dataset_id, y_pred) AS top FROM cell),
ta AS (SELECT DISTINCT dataset_id, y_true, a, t FROM m), tb AS (SELECT DISTINCT dataset_id, y_pred, b, top FROM m),
sa AS (SELECT dataset_id, sum(a * (a - 1) / 2.0) AS sa, -sum(a / t * ln(a / t)) AS ht FROM (SELECT dataset_id, CAST(a AS DOUBLE) AS a, CAST(t AS DOUBLE) AS t FROM ta) GROUP BY 1),
sb AS (SELECT dataset_id, sum(b * (b - 1) / 2.0) AS sb, -sum(b / t * ln(b / t)) AS hp, sum(top) / max(t) AS purity FROM (SELECT dataset_id, CAST(b AS DOUBLE) AS b, top, CAST(sum(b) OVER (PARTITION BY dataset_id) AS DOUBLE) AS t FROM tb) GROUP BY 1),
s AS (SELECT dataset_id, max(t) AS n, sum(n * (n - 1) / 2.0) AS s, sum(n / CAST(t AS DOUBLE) * ln(n * CAST(t AS DOUBLE) / (CAST(a AS DOUBLE) * b))) AS mi FROM m GROUP BY 1),
g AS (SELECT *, sa * sb / (n * (n - 1) / 2.0) AS e, (sa + sb) / 2 AS mx, mi / ht AS hom, mi / hp AS com FROM s JOIN sa USING (dataset_id) JOIN sb USING (dataset_id))"""
PAIRWISE = OWN + """,
pd AS (SELECT a.dataset_id, a.point_id, a.label, b.label AS lb, b.point_id AS pb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM own a JOIN own b ON a.dataset_id = b.dataset_id AND a.point_id <> b.point_id)"""
FLAT = POINTS_SQL + """,
flat AS (SELECT dataset_id, 'x_only' AS view_id, x AS value FROM points UNION ALL SELECT dataset_id, 'y_only', y FROM points UNION ALL SELECT dataset_id, 'xy_2d', x FROM points UNION ALL SELECT dataset_id, 'xy_2d', y FROM points)"""
VECTORS_SQL = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
near AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, list_distance(q.v, r.v) AS distance FROM v q JOIN v r ON {0}q.vec_id <> r.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS position FROM near QUALIFY position <= 5)""".format
VECTORS, TENTH = VECTORS_SQL(""), VECTORS_SQL("q.vec_id % 10 = 0 AND ")
SPLIT_SQL = """part_ix AS (SELECT p_partkey AS dataset_id, p_type AS stratum FROM part),
split AS (SELECT dataset_id, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || dataset_id), dataset_id) - 1 + CAST(('0x' || substr(md5('42:' || stratum), 1, 8)) AS BIGINT) % 16) % 16 + 1 AS INTEGER) AS split_id FROM part_ix)"""

QUERIES = {
    "contingency": lambda s, d: agreement.contingency(_labels(s, d), KEY),
    "external_agreement": lambda s, d: rounded(agreement.agreement(_labels(s, d), KEY)),
    "adjusted_mutual_information": lambda s, d: rounded(agreement.adjusted_mutual_information(_labels(s, d), KEY)),
    "noise_scores": lambda s, d: rounded(agreement.noise_scores(_labels(s, d).withColumn("y_true", F.when(F.col("point_id") % 15 == 0, -1).otherwise(F.col("y_true"))), KEY)),
    "k_metrics": lambda s, d: agreement.k_metrics(_labels(s, d), KEY),
    "label_stats": lambda s, d: rounded(agreement.label_stats(_labels(s, d), KEY)),
    "partition_hash": lambda s, d: agreement.partition_hash(_labels(s, d), KEY),
    "calinski_harabasz": lambda s, d: rounded(indices.calinski_harabasz(points(s, d), KEY)),
    "davies_bouldin": lambda s, d: rounded(indices.davies_bouldin(points(s, d), KEY)),
    "s_dbw": lambda s, d: rounded(indices.s_dbw(points(s, d), KEY)),
    "size_entropy": lambda s, d: rounded(indices.size_entropy(points(s, d), KEY)),
    "min_centroid_distance": lambda s, d: rounded(indices.min_centroid_distance(points(s, d), KEY)),
    "within_dispersion": lambda s, d: rounded(indices.within_dispersion(points(s, d), KEY)),
    "isotropy": lambda s, d: rounded(indices.isotropy(points(s, d), KEY)),
    "eccentricity": lambda s, d: rounded(indices.eccentricity(points(s, d), KEY)),
    "silhouette": lambda s, d: rounded(indices.silhouette(points(s, d), KEY)),
    "noise_aware_silhouette": lambda s, d: rounded(indices.noise_aware_silhouette(points(s, d), KEY)),
    "neighborhood_purity": lambda s, d: rounded(indices.neighborhood_purity(points(s, d), KEY)),
    "neighborhood_purity_multi_k": lambda s, d: rounded(indices.neighborhood_purity(points(s, d), KEY, ks=(5, 10, 20))),
    "min_intercluster_distance": lambda s, d: rounded(indices.min_intercluster_distance(points(s, d), KEY)),
    "dunn": lambda s, d: rounded(indices.dunn(points(s, d), KEY)),
    "normalised_index": lambda s, d: rounded(indices.calinski_harabasz(points(s, d), KEY).select("dataset_id", indices.normalise("calinski_harabasz", F.col("raw"), F.lit(100)).alias("norm"))),
    "block_a_stats": lambda s, d: rounded(metafeatures.block_a(metafeatures.views(points(s, d)), ["dataset_id", "view_id"])),
    "block_b_stats": lambda s, d: rounded(metafeatures.block_b(points(s, d), KEY)),
    "density_grid": lambda s, d: rounded(metafeatures.density_grid(points(s, d), KEY, 16)),
    "mutual_information": lambda s, d: rounded(metafeatures.mutual_information(points(s, d), KEY)),
    "axis_relations": lambda s, d: rounded(metafeatures.relations(points(s, d), KEY)),
    "conditional_variance": lambda s, d: rounded(metafeatures.conditional_variance(points(s, d), KEY)),
    "gini": lambda s, d: rounded(metafeatures.gini(points(s, d).select("dataset_id", F.col("x").alias("value")), KEY)),
    "knn_join_topk": lambda s, d: rounded(_neighbours(s, d, asked="vec_id % 10 = 0")),
    "knn_utility_predict": lambda s, d: rounded(neighbours.predict_utilities(_neighbours(s, d), utilities(s, d))),
    "stratified_split": lambda s, d: splits.stratified_splits(_index(s, d), "stratum"),
    "split_problems": lambda s, d: splits.split_problems(splits.stratified_splits(_index(s, d), "stratum")),
    "loso_folds": lambda s, d: neighbours.loso_folds(splits.stratified_splits(_index(s, d), "stratum")).groupBy("fold", "role").agg(F.count("*").alias("n")),
    "fold_leakage": lambda s, d: neighbours.leakage(neighbours.loso_folds(splits.stratified_splits(_index(s, d), "stratum"))),
    "derived_seeds": lambda s, d: table(s, d, "nation").select("n_nationkey", splits.derive_seed("42", F.col("n_nationkey"), "x_only").alias("seed")),
    "apportion": lambda s, d: splits.apportion(table(s, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).cast("double").alias("share")), 17, ["k"]).select("k", "name", "n"),
    "expand_jobs": lambda s, d: splits.expand_jobs(table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 3).alias("n")), ["n_nationkey"]).select("n_nationkey", "local_idx", "job_id"),
    "policy_slots": lambda s, d: splits.round_robin(_index(s, d), ["stratum"], [F.md5(F.concat(F.lit("s|"), F.col("dataset_id").cast("string")).cast("binary")), F.col("dataset_id")], 10).select("dataset_id", "slot"),
    "generate_clouds": lambda s, d: shapes.generate(_jobs(s, d)),
    "kmeans_kernel": lambda s, d: search.labels_of(points(s, d), "kmeans", {"n_clusters": 3}),
    "dbscan_kernel": lambda s, d: search.labels_of(points(s, d), "dbscan", {"eps": 0.05, "min_samples": 4}),
    "hdbscan_constrained_kernel": lambda s, d: search.labels_of(points(s, d), "hdbscan_constrained-3", {}),
    "search_trials": lambda s, d: search.run_trials(points(s, d), search.candidate_table(s, search.random_space(32, 1234))),
    "sequential_search": lambda s, d: rounded(sequential.run_search(_small_clouds(s, d), n_trials=25, seed=7)),
    "cluster_pipeline": lambda s, d: search.cluster(points(s, d), search.candidate_table(s, search.random_space(32, 7))),
    "pattern_indices": lambda s, d: patterns.pattern_indices(points(s, d), KEY),
    "raster_indices": lambda s, d: rasters.raster_indices(points(s, d), KEY),
    "cvnn": lambda s, d: rounded(density.cvnn(_partitions(s, d), KEY, "candidate")),
    "histogram_boosting": lambda s, d: rounded(_boosted(s, d)),
    "density_indices": lambda s, d: density.density_indices(points(s, d), KEY),
    "meta_descriptors": lambda s, d: descriptors.describe(metafeatures.views(points(s, d)), ["dataset_id", "view_id"]),
    "candidate_targets": lambda s, d: rounded(models.candidate_targets(_slates(s, d), KEY).select("dataset_id", "candidate", "regret", "rank")),
    "policy_targets": lambda s, d: rounded(models.policy_targets(_slates(s, d), KEY).select("dataset_id", "candidate", "regret", "centered")),
    "table_fingerprint": lambda s, d: clouds.fingerprint(table(s, d, "nation")),
    "last_wins": lambda s, d: clouds.last_wins(table(s, d, "nation").select("n_nationkey", "n_name"), table(s, d, "nation").filter("n_nationkey < 5").select("n_nationkey", F.lower("n_name").alias("n_name")), ["n_nationkey"]),
    "standardised_components": lambda s, d: clouds.prepare(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"), ["l_quantity", "l_extendedprice", "l_tax"]).select("l_orderkey", "l_linenumber", "x", "y"),
}

_R = "round({0}, 6)".format
ORACLE_SQL = {
    "contingency": f"WITH {POINTS_SQL} SELECT dataset_id, y_true, y_pred, count(*) AS n FROM points GROUP BY 1, 2, 3",
    "external_agreement": f"WITH {CELLS} SELECT dataset_id, CAST(n AS BIGINT) AS n, round((s - e) / (mx - e), 6) AS ari, round(mi / ((ht + hp) / 2), 6) AS nmi, round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v_measure, round(s / sqrt(sa * sb), 6) AS fowlkes_mallows, round(purity, 6) AS purity FROM g",
    "noise_scores": f"""WITH {POINTS_SQL}, p AS (SELECT dataset_id, point_id % 15 = 0 AS t, y_pred = -1 AS p FROM points)
        SELECT dataset_id, round(avg(CAST(p AS DOUBLE)), 6) AS noise_ratio, CASE WHEN count(*) FILTER (t) > 0 THEN CASE WHEN count(*) FILTER (p) > 0 THEN round(count(*) FILTER (t AND p) / CAST(count(*) FILTER (p) AS DOUBLE), 6) ELSE 0.0 END END AS noise_precision,
            CASE WHEN count(*) FILTER (t) > 0 THEN round(count(*) FILTER (t AND p) / CAST(count(*) FILTER (t) AS DOUBLE), 6) END AS noise_recall, CASE WHEN count(*) FILTER (t) > 0 THEN round(2 * count(*) FILTER (t AND p) / CAST(count(*) FILTER (t) + count(*) FILTER (p) AS DOUBLE), 6) END AS noise_f1 FROM p GROUP BY 1""",
    "k_metrics": f"WITH {POINTS_SQL}, k AS (SELECT dataset_id, count(DISTINCT CASE WHEN y_pred <> -1 THEN y_pred END) AS k, count(DISTINCT CASE WHEN y_true <> -1 THEN y_true END) AS t FROM points GROUP BY 1) SELECT dataset_id, k AS selected_k, t AS true_k, k = t AS k_correct, abs(k - t) AS k_abs_error, k - t AS k_signed_error FROM k",
    "label_stats": f"WITH {POINTS_SQL} SELECT dataset_id, count(DISTINCT CASE WHEN y_pred <> -1 THEN y_pred END) >= 2 AS valid, count(DISTINCT CASE WHEN y_pred <> -1 THEN y_pred END) AS n_clusters, round(avg(CAST(y_pred = -1 AS DOUBLE)), 6) AS noise_ratio, count(DISTINCT y_pred) AS n_labels FROM points GROUP BY 1",
    "calinski_harabasz": f"WITH {OWN}, w AS (SELECT dataset_id, sum(ss) AS within, count(*) AS k FROM cl GROUP BY 1), a AS (SELECT dataset_id, count(*) AS n, (var_pop(x) + var_pop(y)) * count(*) AS ss FROM own GROUP BY 1) SELECT dataset_id, round(((ss - within) / (k - 1)) / (within / (n - k)), 6) AS raw FROM a JOIN w USING (dataset_id)",
    "normalised_index": f"WITH {OWN}, w AS (SELECT dataset_id, sum(ss) AS within, count(*) AS k FROM cl GROUP BY 1), a AS (SELECT dataset_id, count(*) AS n, (var_pop(x) + var_pop(y)) * count(*) AS ss FROM own GROUP BY 1), c AS (SELECT dataset_id, ln(1 + ((ss - within) / (k - 1)) / (within / (n - k))) AS v FROM a JOIN w USING (dataset_id)) SELECT dataset_id, round(v / (v + ln(101)), 6) AS norm FROM c",
    "davies_bouldin": f"WITH {OWN}, s AS (SELECT dataset_id, label, avg(d) AS s FROM far GROUP BY 1, 2), r AS (SELECT g.dataset_id, g.label, max((a.s + b.s) / gap) AS w FROM gaps g JOIN s a ON a.dataset_id = g.dataset_id AND a.label = g.label JOIN s b ON b.dataset_id = g.dataset_id AND b.label = g.lb GROUP BY 1, 2) SELECT dataset_id, round(avg(w), 6) AS raw FROM r GROUP BY 1",
    "s_dbw": f"""WITH {OWN}, per AS (SELECT dataset_id, avg(sqrt(vx ** 2 + vy ** 2)) AS ms, sqrt(sum(sqrt(vx ** 2 + vy ** 2))) / count(*) AS radius FROM cl GROUP BY 1),
        g AS (SELECT dataset_id, sqrt(var_samp(x) ** 2 + var_samp(y) ** 2) AS g FROM own GROUP BY 1),
        pr AS (SELECT a.dataset_id, a.label AS la, b.label AS lb, a.cx, a.cy, b.cx AS bx, b.cy AS by_, (a.cx + b.cx) / 2 AS mx, (a.cy + b.cy) / 2 AS my, radius FROM cl a JOIN cl b ON a.dataset_id = b.dataset_id AND a.label < b.label JOIN per ON per.dataset_id = a.dataset_id),
        dn AS (SELECT pr.dataset_id, la, lb, count(*) FILTER (sqrt((x - mx) ** 2 + (y - my) ** 2) <= radius) AS m, count(*) FILTER (sqrt((x - cx) ** 2 + (y - cy) ** 2) <= radius) AS a, count(*) FILTER (sqrt((x - bx) ** 2 + (y - by_) ** 2) <= radius) AS b FROM pr JOIN own ON own.dataset_id = pr.dataset_id AND own.label IN (la, lb) GROUP BY 1, 2, 3),
        de AS (SELECT dataset_id, avg(CASE WHEN greatest(a, b) > 0 THEN m / CAST(greatest(a, b) AS DOUBLE) ELSE 0 END) AS dens FROM dn GROUP BY 1)
        SELECT dataset_id, round(ms / g + dens, 6) AS raw FROM per JOIN g USING (dataset_id) JOIN de USING (dataset_id)""",
    "size_entropy": f"WITH {OWN}, p AS (SELECT dataset_id, n / CAST(sum(n) OVER (PARTITION BY dataset_id) AS DOUBLE) AS p FROM cl) SELECT dataset_id, round(-sum(p * ln(p)) / ln(count(*)), 6) AS balance, round(1 + sum(p * ln(p)) / ln(count(*)), 6) AS imbalance FROM p GROUP BY 1",
    "min_centroid_distance": f"WITH {OWN} SELECT dataset_id, round(min(gap), 6) AS raw FROM gaps GROUP BY 1",
    "within_dispersion": f"WITH {OWN} SELECT dataset_id, round(avg(s), 6) AS raw FROM (SELECT dataset_id, label, avg(d) AS s FROM far GROUP BY 1, 2) GROUP BY 1",
    "isotropy": f"WITH {OWN}, e AS (SELECT dataset_id, (vx + vy) / 2 AS h, sqrt(((vx - vy) / 2) ** 2 + vxy ** 2) AS p FROM cl WHERE n >= 3) SELECT dataset_id, round(avg(greatest(h - p, 0) / (h + p)), 6) AS raw FROM e GROUP BY 1",
    "eccentricity": f"WITH {OWN}, e AS (SELECT dataset_id, n, (vx + vy) / 2 AS h, sqrt(((vx - vy) / 2) ** 2 + vxy ** 2) AS p FROM cl WHERE n >= 3) SELECT dataset_id, round(sum(n * (1 - exp(-sqrt((h + p) / (h - p)) / 2))) / sum(n), 6) AS raw FROM e GROUP BY 1",
    "silhouette": f"""WITH {PAIRWISE}, m AS (SELECT dataset_id, point_id, label, lb, avg(d) AS d FROM pd GROUP BY 1, 2, 3, 4),
        ab AS (SELECT dataset_id, point_id, max(d) FILTER (label = lb) AS a, min(d) FILTER (label <> lb) AS b FROM m GROUP BY 1, 2) SELECT dataset_id, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS raw FROM ab GROUP BY 1""",
    "noise_aware_silhouette": f"""WITH {PAIRWISE}, m AS (SELECT dataset_id, point_id, label, lb, avg(d) AS d FROM pd GROUP BY 1, 2, 3, 4),
        ab AS (SELECT dataset_id, point_id, max(d) FILTER (label = lb) AS a, min(d) FILTER (label <> lb) AS b FROM m GROUP BY 1, 2), s AS (SELECT dataset_id, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS raw FROM ab GROUP BY 1),
        z AS (SELECT dataset_id, avg(CAST(label = -1 AS DOUBLE)) AS z FROM points GROUP BY 1) SELECT dataset_id, round(raw * (1 - z), 6) AS raw FROM s JOIN z USING (dataset_id)""",
    "neighborhood_purity": f"WITH {PAIRWISE}, r AS (SELECT dataset_id, point_id, label = lb AS same, row_number() OVER (PARTITION BY point_id ORDER BY d, pb) AS rn FROM pd) SELECT dataset_id, round(avg(CAST(same AS DOUBLE)), 6) AS raw FROM r WHERE rn <= 10 GROUP BY 1",
    "neighborhood_purity_multi_k": f"WITH {PAIRWISE}, r AS (SELECT dataset_id, point_id, label = lb AS same, row_number() OVER (PARTITION BY point_id ORDER BY d, pb) AS rn FROM pd) SELECT dataset_id, round((avg(CAST(same AS DOUBLE)) FILTER (rn <= 5) + avg(CAST(same AS DOUBLE)) FILTER (rn <= 10) + avg(CAST(same AS DOUBLE)) FILTER (rn <= 20)) / 3, 6) AS raw FROM r GROUP BY 1",
    "min_intercluster_distance": f"WITH {PAIRWISE} SELECT dataset_id, round(min(d) FILTER (label <> lb), 6) AS raw FROM pd GROUP BY 1",
    "cvnn": f"""WITH {POINTS_SQL},
cands AS (SELECT dataset_id, 1 AS candidate, point_id, x, y, label FROM points UNION ALL SELECT dataset_id, 2, point_id, x, y, CASE WHEN label = -1 THEN -1 ELSE CAST(x >= 0 AS INTEGER) END FROM points),
own AS (SELECT * FROM cands WHERE label <> -1),
pd AS (SELECT a.dataset_id, a.candidate, a.point_id, a.label, b.label AS lb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, b.point_id AS other FROM own a JOIN own b ON a.dataset_id = b.dataset_id AND a.candidate = b.candidate AND a.point_id <> b.point_id),
near AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY dataset_id, candidate, point_id ORDER BY d, other) <= 5),
sep AS (SELECT dataset_id, candidate, max(o) AS sep FROM (SELECT dataset_id, candidate, label, avg(CASE WHEN label <> lb THEN 1.0 ELSE 0.0 END) AS o FROM near GROUP BY 1, 2, 3) GROUP BY 1, 2),
com AS (SELECT dataset_id, candidate, sum(m) AS com FROM (SELECT dataset_id, candidate, label, avg(d) AS m FROM pd WHERE label = lb GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT dataset_id, candidate, round(sep, 6) AS sep, round(com, 6) AS com, round(sep / max(sep) OVER (PARTITION BY dataset_id) + com / max(com) OVER (PARTITION BY dataset_id), 6) AS raw FROM sep JOIN com USING (dataset_id, candidate)""",
    "dunn": f"WITH {PAIRWISE} SELECT dataset_id, round(min(d) FILTER (label <> lb) / max(d) FILTER (label = lb), 6) AS raw FROM pd GROUP BY 1",
    "density_grid": f"""WITH {POINTS_SQL}, sp AS (SELECT dataset_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points GROUP BY 1),
        c AS (SELECT dataset_id, least(floor((x - lx) / (hx - lx) * 16), 15) AS i, least(floor((y - ly) / (hy - ly) * 16), 15) AS j, count(*) AS n FROM points JOIN sp USING (dataset_id) GROUP BY 1, 2, 3),
        r AS (SELECT dataset_id, n, n / CAST(sum(n) OVER (PARTITION BY dataset_id) AS DOUBLE) AS p, row_number() OVER (PARTITION BY dataset_id ORDER BY n, i, j) + 256 - count(*) OVER (PARTITION BY dataset_id) AS r FROM c)
        SELECT dataset_id, round(count(*) / 256.0, 6) AS occupied_ratio_16, round(-sum(p * ln(p)) / ln(256), 6) AS entropy_16, round(max(p), 6) AS max_cell_ratio_16, round(sqrt(sum(n * n) / 256.0 - (sum(n) / 256.0) ** 2) / (sum(n) / 256.0), 6) AS cv_16,
            round(2 * sum(r * n) / (256.0 * sum(n)) - 257 / 256.0, 6) AS gini_16, round(1 - count(*) / 256.0, 6) AS empty_cell_ratio_16 FROM r GROUP BY 1""",
    "mutual_information": f"""WITH {POINTS_SQL}, sp AS (SELECT dataset_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points GROUP BY 1),
        c AS (SELECT dataset_id, least(floor((x - lx) / (hx - lx) * 16), 15) AS i, least(floor((y - ly) / (hy - ly) * 16), 15) AS j, count(*) AS n FROM points JOIN sp USING (dataset_id) GROUP BY 1, 2, 3),
        m AS (SELECT dataset_id, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY dataset_id) AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY dataset_id, i) AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY dataset_id, j) AS DOUBLE) AS b FROM c)
        SELECT dataset_id, round(sum(n / t * ln(n * t / (a * b))), 6) AS mutual_information FROM m GROUP BY 1""",
    "axis_relations": f"WITH {POINTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY x, point_id) AS rx, row_number() OVER (PARTITION BY dataset_id ORDER BY y, point_id) AS ry FROM points) SELECT dataset_id, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman_positional, round(regr_r2(y, x), 6) AS linear_r2, round(regr_slope(y, x), 6) AS slope FROM r GROUP BY 1",
    "conditional_variance": f"""WITH {POINTS_SQL}, b AS (SELECT dataset_id, y, ntile(10) OVER (PARTITION BY dataset_id ORDER BY x, point_id) AS b FROM points), p AS (SELECT dataset_id, b, var_pop(y) AS v, median(y) AS m FROM b GROUP BY 1, 2),
        s AS (SELECT dataset_id, v, m - lag(m) OVER (PARTITION BY dataset_id ORDER BY b) AS s FROM p) SELECT dataset_id, round(avg(v), 6) AS conditional_variance, round(greatest(count(*) FILTER (s > 0), count(*) FILTER (s < 0)) / CAST(count(s) AS DOUBLE), 6) AS monotonicity FROM s GROUP BY 1""",
    "gini": f"WITH {POINTS_SQL}, r AS (SELECT dataset_id, abs(x) AS a, row_number() OVER (PARTITION BY dataset_id ORDER BY abs(x)) AS r, count(*) OVER (PARTITION BY dataset_id) AS n FROM points) SELECT dataset_id, round(2 * sum(r * a) / (max(n) * sum(a)) - (max(n) + 1) / CAST(max(n) AS DOUBLE), 6) AS gini FROM r GROUP BY 1",
    "knn_join_topk": f"WITH {TENTH} SELECT query_id, neighbour_id, round(distance, 6) AS distance, CAST(position AS INTEGER) AS position FROM knn",
    "knn_utility_predict": f"WITH {VECTORS}, {UTILITIES_SQL} SELECT query_id, metric_id, round(greatest(0, least(1, sum(utility / (distance + 1e-9)) / sum(1 / (distance + 1e-9)))), 6) AS utility FROM knn JOIN utilities ON neighbour_id = dataset_id GROUP BY 1, 2",
    "stratified_split": f"WITH {SPLIT_SQL} SELECT dataset_id, stratum, split_id FROM split",
    "split_problems": f"WITH {SPLIT_SQL} SELECT 'repeated' AS problem, count(*) AS n FROM split GROUP BY dataset_id HAVING count(*) > 1",
    "fold_leakage": f"WITH {SPLIT_SQL} SELECT split_id AS fold, dataset_id, count(*) AS n FROM split GROUP BY 1, 2 HAVING count(*) > 1",
    "derived_seeds": "SELECT n_nationkey, CAST(('0x' || substr(sha256('42|' || n_nationkey || '|x_only'), 1, 8)) AS BIGINT) % 2147483648 AS seed FROM nation",
    "apportion": """WITH x AS (SELECT n_regionkey AS k, n_name AS name, round((n_nationkey + 1.0) / sum(n_nationkey + 1.0) OVER (PARTITION BY n_regionkey) * 17, 9) AS x FROM nation),
        r AS (SELECT *, 17 - sum(floor(x)) OVER (PARTITION BY k) AS missing, row_number() OVER (PARTITION BY k ORDER BY x - floor(x) DESC, name) AS rn FROM x) SELECT k, name, CAST(floor(x) + CAST(rn <= missing AS INTEGER) AS BIGINT) AS n FROM r""",
    "expand_jobs": "WITH j AS (SELECT n_nationkey, unnest(range(1, n_nationkey % 3 + 1)) AS local_idx FROM nation WHERE n_nationkey % 3 > 0) SELECT n_nationkey, local_idx, CAST(row_number() OVER (ORDER BY n_nationkey, local_idx) AS INTEGER) AS job_id FROM j",
    "policy_slots": "SELECT p_partkey AS dataset_id, CAST((row_number() OVER (PARTITION BY p_type ORDER BY md5('s|' || p_partkey), p_partkey) - 1) % 10 AS INTEGER) AS slot FROM part",
    "loso_folds": f"WITH {SPLIT_SQL}, f AS (SELECT DISTINCT split_id AS f FROM split) SELECT CAST(f AS INTEGER) AS fold, CASE WHEN split_id = f THEN 'validation' ELSE 'train' END AS role, count(*) AS n FROM split, f GROUP BY 1, 2",
    "candidate_targets": f"WITH {TRIALS_SQL} SELECT dataset_id, candidate, round(max(ari) OVER (PARTITION BY dataset_id) - ari, 6) AS regret, CAST(rank() OVER (PARTITION BY dataset_id ORDER BY ari DESC) AS INTEGER) AS rank FROM wide WHERE valid",
    "policy_targets": f"WITH {TRIALS_SQL} SELECT dataset_id, candidate, round(max(ari) OVER (PARTITION BY dataset_id) - ari, 6) AS regret, round(ari - avg(ari) OVER (PARTITION BY dataset_id), 6) AS centered FROM wide",
    "last_wins": "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN lower(n_name) ELSE n_name END AS n_name FROM nation",
}
A = "A_view_{0}_flat".format
ORACLE_SQL["block_a_stats"] = f"""WITH {FLAT},
    b AS (SELECT dataset_id, view_id, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, median(value) AS med, {', '.join(f"quantile_cont(value, 0.{q}) AS q{q}" for q in ('01', '05', '25', '75', '95', '99'))}, count(*) AS n, kurtosis_pop(value) AS kurt FROM flat GROUP BY 1, 2),
    f AS (SELECT flat.*, mean, sd, lo, hi, med, q01, q05, q25, q75, q95, q99, kurt FROM flat JOIN b USING (dataset_id, view_id)),
    t AS (SELECT dataset_id, view_id, median(abs(value - med)) AS mad, avg(CAST(value <= lo + 0.05 * (hi - lo) AS DOUBLE)) AS tl, avg(CAST(value >= lo + 0.95 * (hi - lo) AS DOUBLE)) AS th, avg(CAST(value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25) AS DOUBLE)) AS oi,
        avg(CAST(abs((value - mean) / sd) > 3 AS DOUBLE)) AS oz, avg(abs((value - mean) / sd)) AS az, avg(((value - mean) / sd) ** 3) AS sk FROM f GROUP BY 1, 2),
    h AS (SELECT dataset_id, view_id, {', '.join(f"least(floor((value - lo) / (hi - lo) * {n}), {n - 1}) AS b{n}" for n in (32, 64))} FROM f),
    h32 AS (SELECT dataset_id, view_id, -sum(p * ln(p)) / ln(32) AS e, max(p) AS pk, 1 - count(*) / 32.0 AS em FROM (SELECT dataset_id, view_id, b32, count(*) / CAST(sum(count(*)) OVER (PARTITION BY dataset_id, view_id) AS DOUBLE) AS p FROM h GROUP BY 1, 2, 3) GROUP BY 1, 2),
    h64 AS (SELECT dataset_id, view_id, -sum(p * ln(p)) / ln(64) AS e FROM (SELECT dataset_id, view_id, b64, count(*) / CAST(sum(count(*)) OVER (PARTITION BY dataset_id, view_id) AS DOUBLE) AS p FROM h GROUP BY 1, 2, 3) GROUP BY 1, 2),
    u AS (SELECT dataset_id, count(*) AS n, count(DISTINCT round_even(x, 6)) / CAST(count(*) AS DOUBLE) AS ux, count(DISTINCT round_even(y, 6)) / CAST(count(*) AS DOUBLE) AS uy, count(DISTINCT (round_even(x, 6), round_even(y, 6))) / CAST(count(*) AS DOUBLE) AS uxy FROM points GROUP BY 1),
    v AS (SELECT b.dataset_id, view_id, u.n, CASE view_id WHEN 'x_only' THEN ux WHEN 'y_only' THEN uy ELSE uxy END AS un FROM b JOIN u USING (dataset_id))
    SELECT dataset_id, view_id, round(ln(1 + v.n), 6) AS A_view_n_points_log1p, CASE view_id WHEN 'xy_2d' THEN 2 ELSE 1 END AS A_view_dim, 1.0 AS A_view_finite_ratio, round(un, 6) AS A_view_unique_ratio_rounded_6, round(1 - un, 6) AS A_view_duplicate_ratio_rounded_6,
        round(mean, 6) AS {A('mean')}, round(sd, 6) AS {A('std')}, round(lo, 6) AS {A('min')}, round(hi, 6) AS {A('max')}, round(hi - lo, 6) AS {A('range')}, {', '.join(f"round(q{q}, 6) AS {A('q' + q)}" for q in ('01', '05', '25', '75', '95', '99'))}, round(med, 6) AS {A('median')}, round(q75 - q25, 6) AS {A('iqr')}, round(sk, 6) AS {A('skew')}, round(kurt, 6) AS {A('kurtosis')},
        round(mad, 6) AS {A('mad')}, round(tl, 6) AS A_view_tail_mass_low_5pct, round(th, 6) AS A_view_tail_mass_high_95pct, round(oi, 6) AS A_view_outlier_ratio_iqr_1_5, round(oz, 6) AS A_view_outlier_ratio_z_3, round(az, 6) AS A_view_mean_abs_zscore,
        round(h32.e, 6) AS A_view_entropy_hist_32, round(h32.pk, 6) AS A_view_peak_bin_ratio_32, round(h32.em, 6) AS A_view_empty_bin_ratio_32, round(h64.e, 6) AS A_view_entropy_hist_64
    FROM b JOIN t USING (dataset_id, view_id) JOIN h32 USING (dataset_id, view_id) JOIN h64 USING (dataset_id, view_id) JOIN v USING (dataset_id, view_id)"""
AXIS = ", ".join(
    f"round(avg({c}), 6) AS B_axis{i}_mean, round(stddev_pop({c}), 6) AS B_axis{i}_std, round(min({c}), 6) AS B_axis{i}_min, round(max({c}), 6) AS B_axis{i}_max, round(max({c}) - min({c}), 6) AS B_axis{i}_range, "
    f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS B_axis{i}_iqr, round(avg(z{c} ** 3), 6) AS B_axis{i}_skew, round(avg(z{c} ** 4) - 3, 6) AS B_axis{i}_kurtosis"
    for i, c in enumerate("xy")
)
GRID = "b{0} AS (SELECT dataset_id, least(floor((x - lx) / (hx - lx) * {0}), {1}) AS i, least(floor((y - ly) / (hy - ly) * {0}), {1}) AS j, count(*) AS n FROM p GROUP BY 1, 2, 3), r{0} AS (SELECT dataset_id, n, n / CAST(sum(n) OVER (PARTITION BY dataset_id) AS DOUBLE) AS p, row_number() OVER (PARTITION BY dataset_id ORDER BY n, i, j) + {2} - count(*) OVER (PARTITION BY dataset_id) AS r FROM b{0}), g{0} AS (SELECT dataset_id, count(*) / {2}.0 AS occ, -sum(p * ln(p)) / ln({2}) AS ent, max(p) AS mx, sqrt(sum(n * n) / {2}.0 - (sum(n) / {2}.0) ** 2) / (sum(n) / {2}.0) AS cv, 2 * sum(r * n) / ({2}.0 * sum(n)) - ({2} + 1) / {2}.0 AS gini FROM r{0} GROUP BY 1)".format
ORACLE_SQL["block_b_stats"] = f"""WITH {POINTS_SQL}, s AS (SELECT dataset_id, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points GROUP BY 1),
    p AS (SELECT *, (x - mx) / sx AS zx, (y - my) / sy AS zy, sqrt((x - mx) ** 2 + (y - my) ** 2) AS d FROM points JOIN s USING (dataset_id)),
    {GRID(16, 15, 256)}, {GRID(32, 31, 1024)},
    a AS (SELECT dataset_id, {AXIS}, count(*) AS n, max(hx - lx) AS w, max(hy - ly) AS h, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c, corr(x, y) AS r, max(sqrt(mx ** 2 + my ** 2)) AS cn,
        round(avg(d), 6) AS B_mean_distance_to_centroid, round(stddev_pop(d), 6) AS B_std_distance_to_centroid, {", ".join(f"round(quantile_cont(d, {q / 100}), 6) AS B_q{q}_distance_to_centroid" for q in (25, 50, 75, 90))} FROM p GROUP BY 1),
    e AS (SELECT *, (vx + vy) / 2 AS hf, sqrt(((vx - vy) / 2) ** 2 + c ** 2) AS pt FROM a)
    SELECT e.* EXCLUDE (n, w, h, vx, vy, c, r, cn, hf, pt), round(w * h, 6) AS B_bbox_area, round(greatest(w, h) / least(w, h), 6) AS B_bbox_aspect_ratio, round(n / (w * h), 6) AS B_bbox_density_points_per_area, round(vx + vy, 6) AS B_cov_trace, round(vx * vy - c * c, 6) AS B_cov_det,
        round((hf + pt) / (hf - pt), 6) AS B_cov_condition_number, round(r, 6) AS B_corr_axis0_axis1, round(abs(r), 6) AS B_abs_corr_axis0_axis1, round(hf + pt, 6) AS B_pca_eigenvalue_1, round(hf - pt, 6) AS B_pca_eigenvalue_2, round((hf + pt) / (2 * hf), 6) AS B_pca_explained_ratio_1, round((hf - pt) / (2 * hf), 6) AS B_pca_explained_ratio_2,
        round((hf + pt) / (hf - pt), 6) AS B_pca_anisotropy_ratio, round(cn, 6) AS B_centroid_norm, {", ".join(f"round(g{b}.occ, 6) AS B_density_grid_{b}_occupied_ratio, round(g{b}.ent, 6) AS B_density_grid_{b}_entropy, round(g{b}.mx, 6) AS B_density_grid_{b}_max_cell_ratio" for b in (16, 32))},
        round(g32.cv, 6) AS B_density_grid_cv, round(g32.gini, 6) AS B_density_grid_gini, round(1 - g32.occ, 6) AS B_density_grid_empty_cell_ratio FROM e JOIN g16 USING (dataset_id) JOIN g32 USING (dataset_id)"""
ORACLE_SQL["adjusted_mutual_information"] = f"""WITH {POINTS_SQL}, c AS (SELECT dataset_id, y_true, y_pred, CAST(count(*) AS DOUBLE) AS k FROM points GROUP BY 1, 2, 3),
    a AS (SELECT dataset_id, y_true, sum(k) AS a FROM c GROUP BY 1, 2), b AS (SELECT dataset_id, y_pred, sum(k) AS b FROM c GROUP BY 1, 2), t AS (SELECT dataset_id, sum(k) AS n FROM c GROUP BY 1),
    mi AS (SELECT dataset_id, sum(k / n * ln(n * k / (a * b))) AS mi FROM c JOIN a USING (dataset_id, y_true) JOIN b USING (dataset_id, y_pred) JOIN t USING (dataset_id) GROUP BY 1),
    ha AS (SELECT dataset_id, -sum(a / n * ln(a / n)) AS ha FROM a JOIN t USING (dataset_id) GROUP BY 1), hb AS (SELECT dataset_id, -sum(b / n * ln(b / n)) AS hb FROM b JOIN t USING (dataset_id) GROUP BY 1),
    cells AS (SELECT dataset_id, a, b, n, unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS k FROM a JOIN b USING (dataset_id) JOIN t USING (dataset_id)),
    emi AS (SELECT dataset_id, sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM cells GROUP BY 1)
    SELECT dataset_id, round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM mi JOIN ha USING (dataset_id) JOIN hb USING (dataset_id) JOIN emi USING (dataset_id)"""
