"""Agreement, indices, meta-features, kernels, search, splits and sources against plain NumPy."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clusterloom.functions.nullsafe import clean_target, clean_utility, number, safe_div, strip_prefix, truthy
from clusterloom.operators import agreement, descriptors, indices, kernels, metafeatures, neighbours, ranking, search, shapes, splits, utility
from clusterloom.plans import point_queries
from clusterloom.sources import clouds


def clouds_of(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.05, (n, 2)) for c in ((0, 0), (1, 0), (0, 1))])
    rows = [(1, i, float(a), float(b), i // n, -1 if i % 29 == 0 else i // n) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "dataset_id int, point_id long, x double, y double, y_true int, label int"), x


def test_cleaning(spark):
    df = spark.createDataFrame([("1.5", float("nan"), "utility__a"), ("x", float("inf"), "b"), (None, -3.0, None), ("inf", 0.4, "utility__")], "t string, v double, n string")
    rows = df.select(number("t").alias("t"), clean_target(F.col("v")).alias("c"), clean_utility(F.col("v")).alias("u"), safe_div(F.lit(1.0), F.col("v")).alias("d"), strip_prefix(F.col("n")).alias("n")).collect()
    assert [r.t for r in rows] == [1.5, None, None, None]
    assert [r.c for r in rows] == [0.0, 0.0, 0.0, 0.4] and [r.u for r in rows] == [0.0, 1.0, 0.0, 0.4]
    assert [r.d for r in rows][:2] == [None, None] and [r.n for r in rows] == ["a", "b", None, ""]
    flags = spark.createDataFrame([(" True ",), ("1",), ("yes",), (None,)], "f string").select(truthy("f").alias("f")).collect()
    assert [r.f for r in flags] == [True, True, False, False]


def test_agreement_is_invariant_to_names_and_perfect_for_equals(spark):
    df, _ = clouds_of(spark)
    same = agreement.agreement(df.select("dataset_id", "y_true", F.expr("10 - y_true").alias("y_pred")), ["dataset_id"]).first()
    assert [same[c] for c in ("ari", "nmi", "v_measure", "fowlkes_mallows", "purity")] == pytest.approx([1.0] * 5)
    assert agreement.adjusted_mutual_information(df.select("dataset_id", "y_true", F.col("y_true").alias("y_pred")), ["dataset_id"]).first().ami == pytest.approx(1)
    one = agreement.agreement(df.select("dataset_id", "y_true", F.lit(0).alias("y_pred")), ["dataset_id"]).first()
    assert one.ari == pytest.approx(0) and one.homogeneity == pytest.approx(0) and one.completeness == 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=2, max_size=30))
def test_expected_mutual_information_is_that_of_shuffles(pairs):
    t, p = np.array(pairs).T
    table = np.zeros((4, 4))
    np.add.at(table, (t, p), 1)
    a, b = (x[x > 0].astype(int) for x in (table.sum(1), table.sum(0)))
    emi = agreement.expected_mutual_information(a, b)
    entropy = min(-(x / x.sum() * np.log(x / x.sum())).sum() for x in (a, b))
    assert -1e-9 <= emi <= entropy + 1e-9


def test_partition_hash_ignores_names(spark):
    df, _ = clouds_of(spark)
    h = lambda c: agreement.partition_hash(df.withColumn("y_pred", c), ["dataset_id"]).first().partition_hash
    assert h(F.col("label")) == h(F.expr("7 - label")) != h(F.expr("label div 2"))


def silhouette_by_definition(x, labels):
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i in range(len(x)):
        own = (labels == labels[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][labels == c].mean() for c in set(labels.tolist()) - {labels[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_kernel_and_size_guard(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, labels = rng.normal(size=(40, 2)), rng.integers(0, 3, 40)
    assert indices.silhouette_kernel(x, labels) == pytest.approx(silhouette_by_definition(x, labels))
    assert indices.silhouette_kernel(x, np.zeros(40)) is None
    df, _ = clouds_of(spark)
    monkeypatch.setattr(indices, "MAX_PAIRWISE", 10)
    with pytest.raises(Exception, match="at most"):
        indices.silhouette(df, ["dataset_id"]).collect()


def test_indices_rank_a_good_partition_above_a_bad_one(spark):
    df, _ = clouds_of(spark)
    bad = df.withColumn("label", (F.col("point_id") % 3).cast("int"))
    for index, up in ((indices.calinski_harabasz, True), (indices.davies_bouldin, False), (indices.silhouette, True), (indices.neighborhood_purity, True), (indices.min_centroid_distance, True), (indices.within_dispersion, False), (indices.dunn, True)):
        a, b = (index(p, ["dataset_id"]).first().raw for p in (df, bad))
        assert (a > b) == up, index.__name__


def test_meta_features_of_constant_and_small_clouds(spark):
    df = spark.createDataFrame([(1, i, 2.0, 2.0) for i in range(5)] + [(2, 0, 0.0, 1.0)], "dataset_id int, point_id long, x double, y double")
    a = metafeatures.block_a(metafeatures.views(df), ["dataset_id", "view_id"])
    assert len(a.columns) == 32 and a.count() == 6
    filled = metafeatures.complete(a).toPandas()
    assert not filled.isna().any().any()
    assert metafeatures.block_b(df, ["dataset_id"]).count() == 2


@pytest.mark.parametrize("name", sorted(set(kernels.ALGORITHMS) - {"hdbscan_constrained"}))
def test_kernels_find_separated_blobs(name):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.03, (40, 2)) for c in ((0, 0), (1, 0), (0, 1))])
    config = {"kmeans": {"n_clusters": 3}, "minibatch_kmeans": {"n_clusters": 3}, "gmm": {"n_components": 3}, "agglomerative": {"n_clusters": 3}, "birch": {"n_clusters": 3}, "spectral": {"n_clusters": 3}, "dbscan": {"eps": 0.1}, "mean_shift": {"bandwidth": 0.3}}.get(name, {})
    labels = kernels.ALGORITHMS[name](x, **config)
    truth = np.repeat([0, 1, 2], 40)
    inside = labels >= 0
    assert inside.mean() > 0.8 and len(set(labels[inside].tolist())) == 3
    assert all(len(set(truth[labels == c].tolist())) == 1 for c in set(labels[inside].tolist()))


@pytest.mark.parametrize("linkage", ["ward", "average", "complete", "single"])
def test_agglomerative_follows_its_linkage(linkage):
    x = np.array([[0.0], [1.0], [3.0], [7.0], [7.5]])
    labels = kernels.agglomerative(x, 2, linkage)
    assert labels.tolist() == [0, 0, 0, 1, 1]


def test_constrained_collapse_has_n_bins():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.03, (30, 2)) for c in ((0, 0), (1, 0), (0, 1), (1, 1))])
    kernel, fixed = kernels.resolve("hdbscan_constrained-3")
    labels = kernel(x, **fixed)
    assert set(labels.tolist()) == {0, 1, 2} and fixed == {"n": 3}
    with pytest.raises(KeyError):
        kernels.resolve("nothing")


def test_failed_trials_are_rows(spark):
    df, _ = clouds_of(spark)
    kernels.register("broken", lambda x: 1 / 0)
    trials = search.candidate_table(spark, [(1, "broken", "{}"), (2, "kmeans", '{"n_clusters": 3}')])
    log = search.run_trials(df, trials, metrics=("silhouette",)).orderBy("candidate").collect()
    assert [r.valid for r in log] == [False, True] and log[0].exception is not None and log[0].norm == 0
    assert search.cluster(df, trials).first().candidate == 2
    del kernels.ALGORITHMS["broken"]


def test_spaces_are_fixed_and_seeded():
    assert len(search.enumerate_space()) == len({(a, c) for _, a, c in search.enumerate_space()})
    assert search.random_space(5, 1) == search.random_space(5, 1) != search.random_space(5, 2)
    assert len(splits.policies()) == 20 and len(splits.regimes()) == 10


def test_knn_join_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:4]}
    for limit in (neighbours.BROADCAST_BYTES, 300):
        monkeypatch.setattr(neighbours, "BROADCAST_BYTES", limit)
        got = {(r.query_id, r.neighbour_id) for r in neighbours.knn_join(df, df, 4, "id", "v").collect()}
        assert got == want


def test_exact_neighbours_override(spark):
    near = spark.createDataFrame([(1, 10, 0.0, 1), (1, 11, 0.5, 2), (2, 10, 1.0, 1), (2, 11, 1.0, 2)], "query_id long, neighbour_id long, distance double, position int")
    u = spark.createDataFrame([(10, "m", 0.2), (11, "m", 1.8)], "dataset_id long, metric_id string, utility double")
    got = {r.query_id: r.utility for r in neighbours.predict_utilities(near, u).collect()}
    assert got[1] == pytest.approx(0.2) and got[2] == pytest.approx(1.0)


def test_scaling_learns_from_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    fitted = neighbours.scaler(train, ["a", "b"])
    out = neighbours.scale(spark.createDataFrame([(5.0, 2.0), (None, float("nan"))], "a double, b double"), fitted, ["a", "b"]).collect()
    assert out[0].features == pytest.approx([3.0, 2.0]) and out[1].features == pytest.approx([0.0, 0.0])


def test_one_se_rule_prefers_the_simpler(spark):
    rows = [("big", 30, s) for s in (0.80, 0.84, 0.82)] + [("small", 5, s) for s in (0.80, 0.83, 0.81)] + [("bad", 1, s) for s in (0.1, 0.2, 0.1)]
    assert neighbours.one_se_rule(spark.createDataFrame(rows, "config string, n_neighbors int, score double")).first().config == "small"


def test_splits_are_balanced_and_leak_nothing(spark):
    index = spark.range(400).select(F.col("id").alias("dataset_id"), (F.col("id") % 3).cast("string").alias("stratum"))
    split = splits.stratified_splits(index, "stratum")
    counts = [r.n for r in split.groupBy("stratum", "split_id").agg(F.count("*").alias("n")).collect()]
    assert max(counts) - min(counts) <= 1 and splits.split_problems(split).count() == 0
    assert neighbours.leakage(neighbours.loso_folds(split)).count() == 0
    assert splits.split_problems(split.union(split.limit(1))).count() == 1


def test_apportionment_sums_to_the_total(spark):
    shares = spark.createDataFrame([("a", 0.2), ("b", 0.35), ("c", 0.3), ("d", 0.15)], "name string, share double")
    for total in (0, 1, 7, 33):
        assert splits.apportion(shares, total).agg(F.sum("n")).first()[0] == total


def test_shapes_and_cycles(spark):
    assert [c["id"] for c in shapes.topological([{"id": "b", "parents": ["a"]}, {"id": "a"}])] == ["a", "b"]
    with pytest.raises(ValueError, match="cycle"):
        shapes.topological([{"id": "a", "parents": ["b"]}, {"id": "b", "parents": ["a"]}])
    rng = np.random.default_rng(0)
    assert all(f(rng, 50).shape == (50, 2) for f in shapes.SHAPES.values())


def test_tie_rules(spark):
    u = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", float("nan")), (1, "d", None), (1, "e", 0.1)], "g int, metric_id string, utility double")
    assert [r.metric_id for r in ranking.top_k(u, 4, ["g"]).orderBy("position").collect()] == ["a", "b", "e", "c"]
    c = spark.createDataFrame([(1, 3, 0.9, 0.2), (1, 2, 0.9 - 1e-13, 0.7), (1, 1, 0.5, 0.8)], "g int, candidate int, objective double, ari double")
    r = ranking.offline_argmax(c, ["g"]).first()
    assert (r.candidate, r.n_tied) == (2, 2) and r.regret == pytest.approx(0.1)


def test_two_rules_for_missing_values(spark):
    s = spark.createDataFrame([(1, 0.5, 0.8), (1, 0.5, None), (2, None, 0.6)], "g int, weight double, norm double")
    online = {r.g: r.objective for r in ranking.aggregate_online(s, ["g"]).collect()}
    offline = {r.g: r.objective for r in ranking.aggregate_offline(s.filter("g = 1"), ["g"]).collect()}
    assert online == pytest.approx({1: 0.4, 2: 0.6}) and offline == {1: None}


def test_soft_cap(spark):
    got = [r[0] for r in spark.createDataFrame([(k,) for k in (0, 1, 5, 6, 9, 30)], "k int").select(ranking.soft_cap(F.col("k"))).collect()]
    assert got == [1, 1, 5, 6, 7, 10]


def test_utility_of_a_perfect_and_a_reversed_index(spark):
    rows = [(m, i, float(i if m == "up" else -i), i / 20) for m in ("up", "down") for i in range(20)] + [("few", i, 1.0, 0.5) for i in range(5)]
    out = {r.m: r.utility for r in utility.utility_score(spark.createDataFrame(rows, "m string, candidate int, score double, relevance double"), ["m"]).collect()}
    assert out["up"] == pytest.approx(1.0) and out["down"] < 0.4 and "few" not in out


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,y,x\n1,2.5,3\n2,bad,4\n")
    got = clouds.read_cloud_csv(spark, f"file://{tmp_path}/a.csv", "d").orderBy("point_id").collect()
    assert [(r.x, r.y) for r in got] == [(3.0, 2.5), (4.0, None)]
    np.save(tmp_path / "b.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert clouds.read_cloud_npy(spark, f"file://{tmp_path}/b.npy", "d").agg(F.sum("x"), F.sum("y")).first()[:] == (4.0, 6.0)
    (tmp_path / "c.arff").write_text("% c\n@relation r\n@attribute a numeric\n@attribute 'k' {u,v}\n@data\n1.5, u\n?, v\n")
    assert [(r.a, r.k) for r in clouds.read_arff(spark, f"file://{tmp_path}/c.arff").orderBy("k").collect()] == [(1.5, "u"), (None, "v")]
    df = spark.createDataFrame([('{"a": 0.5}', "x; y"), (None, '["p","q"]')], "w string, n string")
    rows = df.select(clouds.parse_weights("w").alias("w"), clouds.parse_names("n").alias("n")).collect()
    assert rows[0].w == {"a": 0.5} and rows[0].n == ["x", "y"] and rows[1].n == ["p", "q"]


def test_tables_as_bags(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    assert clouds.fingerprint(a).first() == clouds.fingerprint(a.repartition(3)).first() != clouds.fingerprint(a.distinct()).first()
    assert clouds.same_rows(a, a.orderBy(F.desc("k"))) and not clouds.same_rows(a, a.distinct())
    new = spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted(map(tuple, clouds.last_wins(a, new, ["k"]).collect())) == [(1, "x"), (2, "z")]
    with pytest.raises(ValueError, match="differ"):
        clouds.merge_tables([a, a.withColumnRenamed("v", "w")])
    with pytest.raises(ValueError, match="ground truth"):
        clouds.assert_label_free(a.withColumn("s", F.struct(F.lit(1).alias("ari"))))


def test_patterns_know_their_shapes(spark):
    from clusterloom.operators import patterns

    rng = np.random.default_rng(0)
    made = {n: f(rng, 300) for n, f in shapes.SHAPES.items()}
    score = lambda metric, shape: patterns.partition_score(metric, made[shape], np.zeros(300))
    assert score("hollow_score", "ring") > score("hollow_score", "blob")
    assert score("line_straightness", "line") > score("line_straightness", "blob")
    assert score("arc_circle_fit", "ring") > score("arc_circle_fit", "line")
    assert score("parabolicity", "arc") > score("parabolicity", "blob")
    assert score("convexity_ratio", "uniform") > score("convexity_ratio", "ring")
    assert score("ribbon_thickness", "line") > score("ribbon_thickness", "blob")
    assert score("radial_uniformity", "blob") > score("radial_uniformity", "ring")
    assert score("gridness_2d", "grid") > score("gridness_2d", "uniform")
    assert patterns.parallel_bands(np.concatenate([made["line"] + (0, i) for i in range(4)]), np.repeat(range(4), 300)) > 0.9
    for name in patterns.PATTERNS:
        for shape in made:
            assert score(name, shape) is None or 0 <= score(name, shape) <= 1, (name, shape)
    df, _ = clouds_of(spark)
    out = patterns.pattern_indices(df, ["dataset_id"]).toPandas()
    assert len(out) == len(patterns.POWERS) == 22 - 1 and out["norm"].between(0, 1).all()


def test_triangles_cover_the_hull():
    from clusterloom.operators import patterns

    z = np.random.default_rng(1).uniform(size=(60, 2))
    t = patterns.triangulation(z)
    u, v = z[t[:, 1]] - z[t[:, 0]], z[t[:, 2]] - z[t[:, 0]]
    assert (np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / 2).sum() == pytest.approx(patterns.polygon(patterns.hull(z))[0], rel=1e-2)


def test_rasters_know_their_shapes(spark):
    from clusterloom.operators import rasters

    rng = np.random.default_rng(0)
    made = {n: rasters.draw(shapes.SHAPES[n](rng, 1500), (0, 1, 0, 1)) for n in ("ring", "blob", "line", "uniform", "parallel_bands", "grid")}
    score = lambda metric, shape: rasters.RASTERS[metric].kernel(made[shape])
    assert score("euler_holes_count", "ring") > score("euler_holes_count", "line")
    assert score("hough_arc_circle_strength", "ring") > score("hough_arc_circle_strength", "line")
    assert score("hough_line_strength", "line") > score("hough_line_strength", "blob")
    assert score("connected_components_count", "ring") > score("connected_components_count", "parallel_bands")
    assert score("convexity_ratio_image_based", "blob") > score("convexity_ratio_image_based", "ring")
    for name in rasters.RASTERS:
        for shape in made:
            assert 0 <= score(name, shape) <= 1 + 1e-9, (name, shape)
    df, _ = clouds_of(spark)
    out = rasters.raster_indices(df, ["dataset_id"]).toPandas()
    assert len(out) == len(rasters.RASTERS) == 24 and out["norm"].between(0, 1).all()


def test_image_operations():
    from clusterloom.operators import rasters

    m = np.zeros((256, 256), bool)
    m[10:40, 10:40] = True
    m[20:30, 20:30] = False
    m[100:103, 50:200] = True
    assert sorted(rasters.sizes(m).tolist()) == [450, 800] and rasters.holes(m).tolist() == [100]
    s = rasters.skeleton(m)
    assert (s & ~m).sum() == 0 and len(rasters.sizes(s)) == 2 and s[100:103].sum() <= 150
    assert rasters.box_slope(np.ones((256, 256), bool)) == pytest.approx(2)


def test_descriptors_fill_their_blocks(spark):
    from clusterloom.operators import descriptors

    df, _ = clouds_of(spark)
    out = descriptors.describe(metafeatures.views(df), ["dataset_id", "view_id"]).toPandas()
    two = out[out["view_id"] == "xy_2d"]
    count = two["feature"].str[0].value_counts()
    assert count["G"] == 60 and count["V"] == 60 and count["R"] == 23 and count["L"] >= 28
    assert (out[out["view_id"] == "x_only"]["feature"].str[0] == "R").sum() == 25
    assert two.set_index("feature")["value"]["L_kmeans_best_k_by_silhouette"] == 3
    assert descriptors.two_segment_gain(np.arange(40.0), np.abs(np.arange(40.0) - 20)) > 0.9
    x = np.cos(np.arange(64) * np.pi / 4)
    assert descriptors.acf_peak(x) > 0.8 and descriptors.fft_peak(x) > 0.9


def test_density_indices_prefer_the_true_partition(spark):
    from clusterloom.operators import density

    df, _ = clouds_of(spark)
    bad = df.withColumn("label", (F.col("point_id") % 3).cast("int"))
    good = {r.metric_id: r.oriented for r in density.density_indices(df, ["dataset_id"]).collect()}
    worse = {r.metric_id: r.oriented for r in density.density_indices(bad, ["dataset_id"]).collect()}
    assert set(good) == set(density.DENSITY) and all(good[m] > worse[m] for m in good)
    one = df.withColumn("label", F.lit(0))
    assert all(r.raw is None for r in density.density_indices(one, ["dataset_id"]).collect())


def test_minimax_paths():
    from clusterloom.operators.density import _minimax

    x = np.array([[0.0], [1.0], [3.0], [3.5]])
    want = np.array([[0, 1, 2, 2], [1, 0, 2, 2], [2, 2, 0, 0.5], [2, 2, 0.5, 0]])
    assert np.allclose(_minimax(kernels.distances(x)), want)


def test_utility_net_learns_and_ranks(spark):
    from clusterloom.operators import models

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    t = 1 / (1 + np.exp(-np.stack((x[:, 0], -x[:, 1], x[:, 2] * 0.5), 1)))
    rows = [(int(i), [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, t, strict=True))]
    df = models.hash_folds(spark.createDataFrame(rows, "id int, features array<double>, targets array<double>"), "id", 3)
    net = models.fit_utility_net(df.filter("fold > 0"), [[0, 1], [2]])
    out = models.predict_utility_net(df.filter("fold = 0"), [net, net]).collect()
    error = np.mean([(np.array(r.predicted) - np.array(r.targets)) ** 2 for r in out])
    assert error < 0.01


def test_reranking(spark):
    from clusterloom.operators import models

    rows = [(g, c, c / 10 if g % 2 else (10 - c) / 10, True, {"m": c / 10, "h": 0.5}, ["m"]) for g in range(6) for c in range(10)]
    df = spark.createDataFrame(rows, "g int, candidate int, ari double, valid boolean, norm map<string,double>, observed array<string>")
    wide = models.masked_features(models.candidate_targets(df, ["g"]), ["m", "h"]).withColumn("odd", (F.col("g") % 2).cast("double"))
    assert wide.filter("value__h <> 0 or observed__h <> 0").count() == 0
    score = models.fit_reranker(wide.filter("g < 4"), ["value__m", "odd"], iterations=20)
    chosen = ranking.select_reranked(score(wide.filter("g >= 4")), ["g"]).collect()
    assert {r.g: r.candidate for r in chosen} == {4: 0, 5: 9}
    r = models.recovery(spark.createDataFrame([(0.5, 0.4, 0.6), (0.5, 0.5, 0.5)], "reranked double, original double, oracle double")).collect()
    assert r[0].recovery == pytest.approx(0.5) and r[1].recovery is None
    p = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.1)], "row int, policy string, ari double")
    t = models.policy_targets(p, ["row"])
    assert models.select_policy(t, ["row"], "regret").first().policy == "a" and models.select_policy(t, ["row"], "ari").first().policy == "a"


@pytest.mark.skipif(not Path("/root/testdata/sf0.001/part.parquet").exists(), reason="no test tables here")
def test_folds_hold_every_dataset_in_sixteen_splits(spark):
    d = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{d}/part.parquet").count()
    rows = point_queries.QUERIES["loso_folds"](spark, d).collect()
    by_fold = {f: sum(r.n for r in rows if r.fold == f) for f in range(1, 17)}
    assert {r.fold for r in rows} == set(by_fold) and set(by_fold.values()) == {parts}
    assert sum(r.n for r in rows if r.role == "validation") == parts


def test_clouds_within_the_limits_are_described_whole():
    x = np.random.default_rng(3).normal(size=(1800, 2))
    whole = lambda f: {k: v for k, v in f.items() if "mst" not in k and "sampled" not in k}
    one, other = (descriptors.block_g(x, np.random.default_rng(s)) for s in (1, 2))
    np.testing.assert_equal(whole(one), whole(other))
    few = x[:300]  # 44,850 pairs
    pairs = descriptors.distances(few)[np.triu_indices(300, 1)]
    assert np.isclose(descriptors.block_g(few, np.random.default_rng(1))["G_pairwise_dist_mean_sampled"], pairs.mean(), rtol=1e-12)
    one, other = (descriptors.block_l(x[:800], np.random.default_rng(s)) for s in (1, 2))
    np.testing.assert_equal(one, other)
