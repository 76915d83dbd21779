import numpy as np
import pytest

from clusterloom.operators import density, kernels, patterns, plane, search

SCHEMA = "dataset_id long, point_id long, x double, y double"


def clouds():
    rng = np.random.default_rng(0)
    yield rng.normal(0, 0.12, (300, 2))
    yield np.round(rng.normal(0, 0.12, (300, 2)), 2)  # copies and equal distances
    yield np.concatenate([rng.normal(c, 0.02, (150, 2)) for c in (0, 3)])  # a far gap


def test_blocks_find_what_a_matrix_holds():
    for x in clouds():
        d = kernels.distances(x)
        others = np.where(np.eye(len(x), dtype=bool), np.inf, d)
        here = plane.Plane(x, 16)
        ids, found = here.neighbours(10)
        near = np.argsort(others, 1, kind="stable")[:, :10]
        assert (ids == near).all() and (found == np.take_along_axis(others, near, 1)).all()
        assert (here.order_statistic(90) == np.sort(d, 1)[:, 90]).all()
        sums, count = here.window_sums(x, 0.1)
        assert (count == (d <= 0.1).sum(1)).all() and sums == pytest.approx((d <= 0.1) @ x)
        core = np.sort(d, 1)[:, 5]
        reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
        assert plane.spanning_tree(x, core) == sorted((e, min(a, b), max(a, b)) for e, a, b in kernels.mst(reach))
        for labels in (np.arange(len(x)) % 3, (x[:, 0] > 0).astype(int)):
            assert plane.least_between(x, labels) == np.where(labels[:, None] == labels, np.inf, d).min()


@pytest.mark.parametrize("name, config", [("dbscan", {"eps": 0.05, "min_samples": 4}), ("dbscan", {"eps": 0.01, "min_samples": 3}), ("hdbscan", {"min_samples": 10}), ("hdbscan_constrained", {}), ("mean_shift", {}), ("optics", {"min_samples": 3})])
def test_labels_in_blocks_are_those_of_a_matrix(monkeypatch, name, config):
    for x in clouds():
        expected = kernels.ALGORITHMS[name](x, **config)
        with monkeypatch.context() as m:
            m.setattr(kernels, "MATRIX_POINTS", 10)
            assert (kernels.ALGORITHMS[name](x, **config) == expected).all()


@pytest.mark.parametrize("name, config", [("dbscan", {"eps": 0.05, "min_samples": 4}), ("hdbscan_constrained-3", {})])
def test_clouds_beyond_a_matrix_are_clustered(spark, name, config):
    x = np.concatenate([np.random.default_rng(c).normal(c, 0.05, (3_500, 2)) for c in range(3)])  # more than 10^8 distances
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(x)], SCHEMA)
    labels = np.array([r.label for r in search.labels_of(df, name, config).orderBy("point_id").collect()]).reshape(3, -1)
    assert [np.bincount(own[own >= 0], minlength=3).argmax() for own in labels] == [0, 1, 2]
    assert all((own == c).mean() > 0.9 for c, own in enumerate(labels))


def test_silhouettes_of_several_partitions_are_those_of_each():
    from clusterloom.operators import indices

    for x in clouds():
        one = np.arange(len(x)) % 3
        two = np.where(one == 1, -1, (x[:, 0] > 0).astype(int))
        expected = [indices.silhouette_kernel(x[p >= 0], p[p >= 0]) for p in (one, two)]
        assert indices.silhouettes(x, [one, np.zeros(len(x), int), two]) == [pytest.approx(expected[0]), None, pytest.approx(expected[1])]


def test_trials_of_clouds_beyond_a_matrix_are_no_failures(spark):
    x = np.concatenate([np.random.default_rng(c).normal(c, 0.05, (3_500, 2)) for c in range(3)])
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(x)], SCHEMA)
    rows = [(1, "dbscan", '{"eps": 0.05, "min_samples": 4}'), (2, "hdbscan_constrained-3", "{}"), (3, "dbscan", '{"eps": 0.05, "min_samples": 4}')]
    log = search.run_trials(df, search.candidate_table(spark, rows), metrics=("silhouette", "neighborhood_purity")).collect()
    assert len(log) == 6 and all(r.exception is None and r.valid for r in log)
    assert sorted((r.metric_id, r.raw) for r in log if r.candidate == 1) == sorted((r.metric_id, r.raw) for r in log if r.candidate == 3)


def test_mean_shift_and_optics_hold_no_matrix(monkeypatch):
    x = np.concatenate([np.random.default_rng(c).normal(c, 0.05, (600, 2)) for c in range(2)])
    monkeypatch.setattr(kernels, "MAX_CELLS", 100_000)
    assert len(set(kernels.mean_shift(x).tolist())) == 2
    assert len(kernels.optics(x)) == 1_200


@pytest.mark.parametrize("name", ["dbcv", "cop", "cvdd", "dcsi"])
def test_density_indices_in_blocks_are_those_of_a_matrix(monkeypatch, name):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.6, (n, 2)) for c, n in (((0, 0), 150), ((3, 0.5), 90), ((1, 4), 60))])
    x[7], x[20:23] = x[8], x[24]
    labels = np.repeat([4, 1, 2, 9], (150, 90, 57, 3))
    want = density.DENSITY[name](x, labels)
    monkeypatch.setattr(kernels, "MATRIX_POINTS", 10)
    monkeypatch.setattr(kernels, "MAX_CELLS", 4_000)  # no matrix of all distances
    assert density.DENSITY[name](x, labels) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("name", ["alpha_shape_compactness", "convexity_ratio", "direction_entropy", "mst_smoothness", "connectivity_components"])
def test_patterns_in_blocks_are_those_of_a_matrix(monkeypatch, name):
    for x in clouds():
        z = x - x.mean(0)
        want = patterns.cluster_score(name, z)
        with monkeypatch.context() as m:
            m.setattr(kernels, "MATRIX_POINTS", 10)
            m.setattr(kernels, "MAX_CELLS", 4_000)  # no matrix of all distances
            assert patterns.cluster_score(name, z.copy()) == pytest.approx(want, rel=1e-12)


def test_shared_neighbour_index_in_blocks_is_that_of_a_matrix(monkeypatch):
    for x in clouds():
        labels = np.random.default_rng(2).integers(0, 3, len(x))
        want = density.cvnn_parts(x, labels)
        assert plane.distance_sum(x, 16, 50) == pytest.approx(kernels.distances(x).sum(), rel=1e-12)
        with monkeypatch.context() as m:
            m.setattr(kernels, "MATRIX_POINTS", 10)
            m.setattr(kernels, "MAX_CELLS", 4_000)
            assert density.cvnn_parts(x, labels) == pytest.approx(want, rel=1e-12)
