"""Comparison suite, audits, prediction scores, and index formulas by hand."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import audits, comparisons, descriptors, patterns, predictions, rasters

BEST = "dataset_id long, method_name string, best_ari double, view_median double, view_mean double, best_runtime_sec double, total_runtime_sec double, best_view string, n_success long, n_views long, family long"


def best(spark, scores):
    rows = [(d, m, a, a, a, 1.0, 2.0, "x_only", 3, 3, d % 2) for m, own in scores.items() for d, a in enumerate(own)]
    return spark.createDataFrame(rows, BEST)


@pytest.mark.parametrize(("t", "df", "p"), [(0.0, 5, 1.0), (2.570582, 5, 0.05), (12.706205, 1, 0.05), (2.042272, 30, 0.05), (-2.749996, 30, 0.01), (1.0, 1, 0.5)])
def test_students_p_equals_the_tables(t, df, p):
    assert abs(comparisons.student_two_sided(t, df) - p) < 1e-6


def test_paired_t_and_hypotheses(spark):
    frame = best(spark, {"a": [0.9, 0.7, 0.8, 0.6], "b": [0.5, 0.6, 0.4, 0.5], "c": [0.9, 0.7, 0.8, 0.6]})
    rows = {r.hypothesis: r for r in comparisons.run_hypotheses(frame, [("x", "f", "a", "b"), ("same", "f", "a", "c")], draws=50).collect()}
    d = np.array([0.4, 0.1, 0.4, 0.1])
    assert abs(rows["x"].t - d.mean() / d.std(ddof=1) * 2) < 1e-9 and rows["x"].wins == 4 and rows["same"].ties == 4
    assert rows["same"].t is None and rows["same"].p_value is None


def test_mann_whitney_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [("m", bool(i % 3), float(v)) for i, v in enumerate(rng.integers(0, 8, 40))]
    r = comparisons.mann_whitney(spark.createDataFrame(rows, "k string, side boolean, v double"), ["k"], "side", "v").first()
    u = sum((a > b) + 0.5 * (a == b) for _, s, a in rows if s for _, o, b in rows if not o)
    assert r.u == u and 0 < r.p_value <= 1


def test_declared_variants_differ_in_one_field():
    methods = [{"method_name": f"{s}_{k}_{w}", "source": s, "k": k, "weighting": w} for s, k, w in itertools.product(("real", "mlp", "knn"), ("top1", "top3"), ("raw", "softmax"))]
    pairs = comparisons.variant_contrasts(methods, "weighting", "raw", "softmax", "weighting_gap")
    assert len(pairs) == 6 and ("weighting_gap", "mlp_top3_raw", "mlp_top3_softmax") in pairs
    assert len(comparisons.variant_contrasts(methods, "source", "real", "knn", "utility_prediction_gap")) == 4


def test_placeholders_are_resolved_everywhere():
    node = {"methods": ["x", "@representative:a"], "deep": [{"m": ("@representative:b",)}], "n": 3}
    assert comparisons.resolve_placeholders(node, {"a": "A", "b": "B"}) == {"methods": ["x", "A"], "deep": [{"m": ["B"]}], "n": 3}
    with pytest.raises(KeyError):
        comparisons.resolve_placeholders("@representative:c", {})


def test_a_suite_runs_end_to_end(spark):
    rows = [(d, m, v, i, a, 1.0, "success", 3, 3, d % 2) for d in range(6) for m, a in (("a", 0.9), ("b", 0.4 + d / 20)) for i, v in enumerate(comparisons.VIEWS)]
    runs = spark.createDataFrame(rows, "dataset_id long, method_name string, view_id string, view_rank int, ari double, runtime_sec double, status string, selected_k int, true_k int, family long")
    out = comparisons.run_suite(runs, {"methods": ["@representative:global", "b"], "contrasts": [["gap", "@representative:global", "b"]]})
    assert out["gaps"].first().n == 6 and out["problems"].count() == 0 and {r.supported for r in out["capabilities"].filter("analysis = 'vbs'").collect()} == {True}
    assert out["vbs"].first().vbs_mean == pytest.approx(0.9)


def test_a_larger_portfolio_is_never_below(spark):
    from clusterloom.operators import portfolio

    frame = best(spark, {"a": [0.2, 0.9], "b": [0.5, 0.1]})
    small, whole = portfolio.virtual_best(frame, ["a"]), portfolio.virtual_best(frame)
    assert comparisons.vbs_problems(whole, frame).count() == 0
    assert {r.problem for r in comparisons.vbs_problems(whole, frame, small).collect()} == {"monotone"}


def test_prediction_scores_by_hand(spark):
    vectors = spark.createDataFrame([(1, "a", 0.9, 0.2), (1, "b", 0.5, 0.8), (1, "c", 0.1, 0.1)], "dataset_id long, metric_id string, truth double, predicted double")
    one = predictions.top1_scores(vectors, ["dataset_id"]).first()
    assert (one.hit, one.rank_distance, round(one.utility_error, 9), round(one.calibration_error, 9)) == (False, 1, 0.4, 0.3)
    top = predictions.top_k_scores(vectors, ["dataset_id"], 2).first()
    assert (top.overlap, top.ordered, top.n_union) == (1.0, 0.0, 2)
    rank = predictions.rank_scores(vectors, ["dataset_id"]).first()
    assert round(rank.pairwise, 9) == round(2 / 3, 9) and round(rank.spearman, 9) == 0.5 and rank.displacement_max == 1


def test_policies_share_rerankers_by_source_and_k():
    policies = [{"policy_id": f"{s}_{k}_{w}", "source": s, "top_k": k, "weighting": w} for s, k, w in itertools.product(("mlp", "knn"), (1, 3, 5, 10, "dynamic"), ("raw", "softmax"))]
    rows = predictions.policy_rerankers(policies)
    assert len(rows) == 20 and len({r["reranker_id"] for r in rows}) == 10 and {"MLP_TOP1", "KNN_DYNAMIC"} < {r["reranker_id"] for r in rows}
    assert len(predictions.policy_features(["m1"], ["u1", "u2"], "META_UTILITIES")) == 6


def test_out_of_fold_predictions_never_use_the_own_fold(spark):
    features = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "dataset_id long, features array<double>")
    folds = spark.createDataFrame([(i, i // 2) for i in range(6)], "dataset_id long, fold int")
    utilities = spark.createDataFrame([(i, "m", i / 10) for i in range(6)], "dataset_id long, metric_id string, utility double")
    got = {r.dataset_id: r.utility for r in predictions.out_of_fold(folds, features, utilities, 1).collect()}
    assert got == pytest.approx({0: 0.2, 1: 0.2, 2: 0.1, 3: 0.4, 4: 0.3, 5: 0.3})


def test_registry_filters():
    registry = [{"method_name": "a", "kind": "x"}, {"method_name": "b", "kind": "y"}, {"method_name": "c", "kind": "x"}]
    assert audits.methods_where(registry, kind="x") == ["a", "c"]
    assert [m["method_name"] for m in audits.select_methods(registry, ["c", "a"])] == ["a", "c"]
    with pytest.raises(ValueError, match="unknown"):
        audits.select_methods(registry, ["z"])


def raster(mask):
    return rasters.Raster(rasters.blur(mask.astype(float), 1.0), mask)


def blank():
    return np.zeros((rasters.SIZE, rasters.SIZE), bool)


def test_orientation_and_coherence_of_one_edge_and_of_a_disc():
    bar, disc = blank(), blank()
    bar[100:156] = True  # a band's two long edges have one orientation; its ends at the border count against it
    y, x = np.indices(disc.shape) - 128
    disc[np.hypot(y, x) < 60] = True
    for kernel in (rasters.orientation_histogram_entropy, rasters.edge_coherence):
        assert 0.8 < kernel(raster(bar)) < 1 and kernel(raster(bar)) == pytest.approx(kernel(raster(bar.T)))
        assert kernel(raster(disc)) < 0.05


def test_co_occurrence_of_a_flat_image_and_of_stripes():
    flat = rasters.Raster(np.ones((rasters.SIZE, rasters.SIZE)), ~blank())
    assert rasters.glcm_haralick(flat) == pytest.approx(1.0)  # one cell: contrast 0, homogeneity 1, energy 1
    gray = np.zeros((256, 256))
    gray[:, ::2] = 1.0  # levels 15 and 0 alternate along x
    across, along = (225.0, 1 / 16, 0.5), (0.0, 1.0, 0.5)
    contrast, alike, energy = np.mean([across, along, along, along], axis=0)
    assert rasters.glcm_haralick(rasters.Raster(gray, gray > 0)) == pytest.approx(math.exp(-contrast / (0.35 * 225)) * alike * math.sqrt(energy), rel=1e-3)


def test_binary_patterns_of_equal_tiles_and_of_one_that_differs():
    assert rasters.lbp_stationarity(rasters.Raster(np.ones((256, 256)), ~blank())) == pytest.approx(1.0)
    gray = np.ones((256, 256))
    gray[:64, :64] = np.random.default_rng(0).uniform(0.5, 1, (64, 64))
    assert 0.2 < rasters.lbp_stationarity(rasters.Raster(gray, ~blank())) < 0.95


def test_holes_and_parts_are_counted():
    def with_holes(n):
        m = blank()
        m[20:236, 20:236] = True
        for i in range(n):
            m[40:80, 30 + 50 * i : 60 + 50 * i] = False
        return raster(m)

    for n in range(4):
        assert rasters.euler_holes_count(with_holes(n)) == pytest.approx((1 - math.exp(-1.5 * n)) / (1 + 0.15 * max(0, n - 2)))
    for n in (1, 2, 3):
        m = blank()
        for i in range(n):
            m[20:60, 20 + 80 * i : 60 + 80 * i] = True
        assert rasters.connected_components_count(raster(m)) == pytest.approx(math.exp(-0.85 * (n - 1)))


def test_periodicity_is_seven_tenths_waves_and_three_tenths_elongation():
    rng = np.random.default_rng(1)
    z = np.column_stack((rng.normal(0, 4, 400), np.repeat(np.arange(4), 100) + rng.normal(0, 0.03, 400)))
    h = np.histogram(z[:, 1], 20)[0]
    f = np.abs(np.fft.rfft(h - np.convolve(h, np.ones(3) / 3, "same")))[1:]
    share = f.max() / f.sum() if np.count_nonzero(h) >= 8 else 0.0
    assert patterns.periodicity_1d(z) == pytest.approx(0.7 * share + 0.3 * (1 - math.exp(-z[:, 0].std() / z[:, 1].std() / 2)))


def test_rank_agreement_and_two_lines_by_brute_force():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, 80).astype(float), rng.integers(0, 12, 80).astype(float)
    signs = [np.sign(a - b) * np.sign(c - d) for (a, c), (b, d) in itertools.combinations(zip(x, y, strict=True), 2)]
    assert descriptors.rank_agreement(x, y) == pytest.approx(sum(signs) / np.count_nonzero(signs))
    u, v = np.sort(rng.uniform(0, 1, 50)), rng.uniform(0, 1, 50)
    error = lambda a, z: ((v[a:z] - np.polyval(np.polyfit(u[a:z], v[a:z], 1), u[a:z])) ** 2).sum()
    cuts = sorted({int(5 + i / 6 * 40) for i in range(7)})
    assert descriptors.two_segment_gain(u, v) == pytest.approx(1 - min(error(0, c) + error(c, 50) for c in cuts) / error(0, 50))


def test_enriched_metrics_are_named_by_the_registry(spark):
    df = spark.createDataFrame([("Davies Bouldin",), ("none",)], "n string")
    key = audits.metric_key(F.col("n"), {"davies_bouldin": "davies_bouldin"})
    assert [r.k for r in df.select(key.alias("k")).collect()] == ["davies_bouldin", None]


def test_a_repository_of_folders_is_read(spark, tmp_path):
    import json

    from clusterloom.sources import repository as rep

    for k, name in enumerate(("d1", "d2")):
        own = tmp_path / "fam" / "subfamilies" / "sub" / name
        for folder in ("features", "utility/x_only", "results/m"):
            (own / folder).mkdir(parents=True)
        (own / "features/features_records.csv").write_text(f"dataset_id,view_mode,a,b\n{name},x_only,{k}.5,bad\n")
        if k == 0:
            (own / "utility/x_only/utility_vector.json").write_text(json.dumps({"utilities": {"utility__s": 0.25, "t": 1.0}}))
        (own / "results/m/x_only.json").write_text(json.dumps({"status": "success", "ari": 0.5, "runtime_sec": 1.0, "selected_k": 2, "true_k": 2}))
    (tmp_path / "fam/subfamilies/sub/empty").mkdir()
    root = f"file://{tmp_path}"
    assert sorted(r.dataset_id for r in rep.dataset_index(spark, root).collect()) == ["d1", "d2"]
    rows = rep.feature_rows(spark, root)
    assert {r.dataset_id: r.features for r in rep.feature_vector(rows, ["b", "a", "c"]).collect()} == {"d1": [None, 0.5, None], "d2": [None, 1.5, None]}
    utilities = rep.utility_rows(spark, root)
    assert sorted((r.dataset_id, r.view_id, r.metric_id, r.utility) for r in utilities.collect()) == [("d1", "x_only", "s", 0.25), ("d1", "x_only", "t", 1.0)]
    table, missing = rep.training_rows(rows, utilities, ["s", "t"])
    assert [r.utility__s for r in table.collect()] == [0.25] and [r.dataset_id for r in missing.collect()] == ["d2"]
    splits = spark.createDataFrame([("d1", 3)], "dataset_id string, split_id int")
    ids = ["family", "subfamily", "dataset_id", "view_id"]
    assert rep.unified_table(table, splits, ids, 2, 2).first().split_id == 3
    with pytest.raises(ValueError, match="expected 5"):
        rep.unified_table(table, splits, ids, 5)
    runs = rep.collect_runs(spark, root).collect()
    assert len(runs) == 6 and sum(r.status == "success" for r in runs) == 2 and sum(r.status == "missing" for r in runs) == 4


def test_finished_records_are_final_and_reused_with_their_provenance(spark, tmp_path):
    from clusterloom.sources.repository import IntegrityError, ResultStore

    store = ResultStore(spark, f"file://{tmp_path}/store")
    assert store.reuse("search", "a", {}) is None
    store.put("search", "a", "RUNNING")
    assert store.reuse("search", "a", {}) is None
    store.put("search", "a", "COMPLETE", {"seed": 1, "code": "x"}, {"ari": 0.5})
    assert store.reuse("search", "a", {"code": "x", "seed": 1}) == {"ari": 0.5}
    with pytest.raises(IntegrityError, match="provenance"):
        store.reuse("search", "a", {"seed": 2})
    with pytest.raises(IntegrityError, match="complete"):
        store.put("search", "a", "FAILED")


def test_configs_of_both_shapes_and_patience(spark):
    from clusterloom.operators import learning

    new = '{"search_space": {"kmeans": {"n_clusters": [2, 3]}}, "cvi": {"metrics": {"silhouette": 0.4}}, "search_algorithm": {"type": "brute_force"}}'
    old = '{"search_space": {"kmeans": {"n_clusters": [2, 3]}}, "cvi": {"metrics": ["silhouette"]}, "search_algorithm": "random", "search_algorithm_params": {"n": 4, "seed": 1}}'
    assert learning.parse_config(new)["weights"] == {"silhouette": 0.4} and len(learning.candidates_of(learning.parse_config(new))) == 2
    assert learning.parse_config(old)["weights"] == {"silhouette": 1.0} and len(learning.candidates_of(learning.parse_config(old))) == 4
    scores = [0.1, 0.3, 0.2, None, 0.25, 0.9]
    trials = spark.createDataFrame([("d", i, s) for i, s in enumerate(scores)], "dataset_id string, candidate int, objective double")
    assert sorted(r.candidate for r in learning.within_patience(trials, ["dataset_id"], 2).collect()) == [0, 1, 2, 3]
    slate = [("kmeans", {"k": 2}), ("hdbscan_constrained-3", {}), ("gmm", {"k": 2}), ("hdbscan_constrained-4", {})]
    spare = {"kmeans": [{"k": 2}, {"k": 5}], "gmm": [{"k": 6}]}
    assert learning.replace_constrained(slate, spare) == [("kmeans", {"k": 2}), ("gmm", {"k": 6}), ("gmm", {"k": 2}), ("kmeans", {"k": 5})]


def test_configuration_features_masks_and_heads(spark):
    from clusterloom.operators import learning

    df = spark.createDataFrame([("kmeans", '{"n_clusters": 3}'), ("hdbscan_constrained-4", "{}")], "algorithm string, config string")
    a, b = df.select(*learning.config_block(["kmeans", "hdbscan_constrained"], ["n_clusters"], ["linkage"])).collect()
    assert tuple(a) == (1, 0, 0, 0, 3, 1, 0) and tuple(b) == (0, 1, 4, 1, 0, 0, 0)
    wide = spark.createDataFrame([(["s"], 0.5, 0.7)], "observed array<string>, value__s double, value__t double")
    assert [(r.metric_id, r.n) for r in learning.hidden_values(wide, ["s", "t"]).collect()] == [("t", 1)]
    assert learning.head_mapping(["utility__a", "utility__b", "utility__c"], {"g": ["c", "a"], "none": ["z"]}) == {"g": [0, 2], "other": [1]}
    frozen = learning.FrozenPredictor([[0.0], [1.0], [3.0]], [[0.1], [0.5], [0.9]], ["m"], 2)
    assert frozen.predict([1.0], "k")["m"] == 0.5 and frozen.predict([99.0], "k")["m"] == 0.5


def test_networks_and_forests_learn(spark):
    from clusterloom.operators import learning

    rng = np.random.default_rng(0)
    rows = [(float(a), float(b) if i % 9 else None, float(0.5 + 0.3 * a), "up" if a > 0 else "down") for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, ari double, best string")
    told = learning.fit_ari_network(df, ["a", "b"], epochs=100, rate=0.01)(df).select("ari", "predicted_ari").toPandas()
    assert np.corrcoef(told.ari, told.predicted_ari)[0, 1] > 0.95
    said = learning.fit_index_classifier(df, ["a", "b"], "best", trees=10)(df).select((F.col("best") == F.col("predicted_best")).alias("hit")).collect()
    assert np.mean([r.hit for r in said]) > 0.95


def test_every_shape_profile_and_perturbation_keeps_its_promise(spark):
    from clusterloom.operators import profiles, shapes

    rng = lambda: np.random.default_rng(5)
    made = {n: f(rng(), 2000) for n, f in shapes.SHAPES.items()}
    assert all(x.shape == (2000, 2) and np.isfinite(x).all() for x in made.values()) and len(made) >= 27
    r = np.hypot(*made["ring_annulus"].T)
    assert r.min() >= 0.6 and r.max() <= 1
    assert np.corrcoef(made["parabola"][:, 0] ** 2, made["parabola"][:, 1])[0, 1] > 0.99
    sides = np.abs(shapes.SHAPES["rectangle_frame"](rng(), 500, frame_thickness=0.0)) / (1.0, 0.6)
    assert np.allclose(sides.max(1), 1)
    cells = np.floor(shapes.SHAPES["checker_texture"](rng(), 500, jitter=0.0) / 0.4 + 1.5 / 0.4).astype(int)
    assert (cells.sum(1) % 2 == 0).all()
    circle = made["circle"]
    gap = profiles.PROFILES["occlusion"](rng(), circle, "center_occluded")
    assert 0.6 < len(gap) / len(circle) < 0.9
    full = profiles.PROFILES["fill"](rng(), circle, "filled")
    assert np.median(np.hypot(*full.T)) < 1.6 < np.median(np.hypot(*circle.T))
    wide = profiles.PROFILES["thickness"](rng(), made["band"], {"profile": "linear_taper", "low": 1.0, "high": 6.0})
    left = wide[:, 0] < np.median(wide[:, 0])
    assert max(wide[left, 1].std(), wide[~left, 1].std()) > 1.8 * min(wide[left, 1].std(), wide[~left, 1].std())
    x, y = np.vstack((made["blob"], made["blob"] + 3)), np.repeat([0, 1], 2000)
    for spec, more in (({"dropout": 0.5}, -1), ({"contamination": 0.1}, 1), ({"duplicates": 0.1}, 1), ({"bridges": 2}, 1), ({"holes": {"n_holes": 1}}, -1), ({"size_imbalance": 0.8}, -1), ({"density_imbalance": 0.8}, -1)):
        a, b = profiles.perturb(rng(), x, y, spec)
        assert len(a) == len(b) and np.sign(len(a) - len(x)) == more
    _, flipped = profiles.perturb(rng(), x, y, {"difficulty": {"label_flip_rate": 0.25, "global_jitter_sigma": 0.01}})
    assert 0.2 < (flipped != y).mean() < 0.3
    times, _ = profiles.perturb(rng(), x, y, {"arrival_times": {"pri_dim": 0}})
    assert (np.diff(times[:, 1]) >= 0).all()
    with pytest.raises(ValueError, match="unknown"):
        profiles.perturb(rng(), x, y, {"nothing": 1})
    assert shapes.sample_prior(rng(), {"a": {"dist": "choice", "values": [7]}, "b": 2}) == {"a": 7, "b": 2}
    assert 1e-3 <= shapes.sample_prior(rng(), {"dist": "loguniform", "low": 1e-3, "high": 1e-1}) <= 1e-1


def test_bands_symmetry_polygons_and_corners_by_hand():
    bands, square = blank(), blank()
    for i in range(3):
        bands[60 + 50 * i : 70 + 50 * i, 28:228] = True
    square[78:178, 78:178] = True
    h = np.convolve(np.where(bands.any(1), 1.0, 0.0), np.ones(11) / 11, "same")
    assert rasters.morphological_band_count(raster(bands)) == pytest.approx((1 - math.exp(-1.05)) * h.max(), rel=0.02)
    assert rasters.symmetry_score(raster(square)) == pytest.approx(1.0)
    assert rasters.polygonality(raster(square)) == pytest.approx(1 - 1 / 9, rel=0.03)
    runs = rasters._segments(np.argwhere(rasters.edges(square)).astype(float), 50, 30, 5)
    assert len(runs) == 4 and runs.min() > 90
    assert rasters.hough_line_strength(raster(square)) > 0.9 and rasters.peak_to_background_hough(raster(square)) < 0.1
    n, edge = 4, rasters.edges(square).sum()
    assert rasters.corner_junction_density(raster(square)) == pytest.approx(1 - math.exp(-n / edge / 0.015), rel=0.05)
    s = rasters.skeleton(bands)
    ends, junctions = rasters._crossings(s)
    box = np.prod(np.ptp(np.argwhere(s), axis=0) + 1)
    assert rasters.skeleton_connectivity(raster(bands)) == pytest.approx(math.exp(-0.4 * 2 - 0.005 * (ends - 2) - 0.01 * junctions) * (1 - math.exp(-8 * s.sum() / box)))


def test_two_lines_are_bimodal_and_one_is_not():
    rng = np.random.default_rng(4)
    t = rng.uniform(-5, 5, 800)
    two = np.column_stack((t, np.where(np.arange(800) % 2, 1.0, -1.0) + rng.normal(0, 0.05, 800)))
    one = np.column_stack((t, rng.normal(0, 1, 800)))
    long = patterns.stretch(two[:, 0], two[:, 1])
    assert patterns.bimodality_anti_thickness(two) == pytest.approx(0.7 * (0.55 + 0.45 * (1 - math.exp(-2 / two[:, 1].std()))) + 0.3 * long, abs=0.03)
    assert patterns.bimodality_anti_thickness(one) < patterns.bimodality_anti_thickness(two)
