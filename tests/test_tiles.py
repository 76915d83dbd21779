"""Indices of clouds that are compared in tiles equal those of one task."""

from __future__ import annotations

import numpy as np
import pytest

from clusterloom.operators import density, indices, kernels, search, tiles

POINTS = "dataset_id long, point_id long, x double, y double, label int"


@pytest.fixture(scope="module")
def clouds(spark):
    """Two clouds of some hundred points, with noise, repeated points and a singleton cluster, in small blocks."""
    rng = np.random.default_rng(8)
    rows = []
    for d, n in ((0, 26), (1, 20)):
        z = np.concatenate([rng.normal(c, 0.5, (n, 2)) for c in ((0, 0), (3, 0.5), (1, 4))])
        z[5], z[7] = z[6], z[6]
        labels = np.repeat([0, 1, 2], n)
        labels[::17] = -1
        rows += [(d, 1000 * d + i, float(x), float(y), int(c)) for i, ((x, y), c) in enumerate(zip(z, labels, strict=True))]
    rows.append((1, 9999, 9.0, 9.0, 7))
    return spark.createDataFrame(rows, POINTS).repartition(3)


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "CHUNK", 3)
    make = tiles.laid_out
    monkeypatch.setattr(tiles, "laid_out", lambda points, keys, extra=(), size=40: make(points, keys, extra, 40))


def values(df, *by):
    return {tuple(r[b] for b in by): None if r.raw is None else round(r.raw, 9) for r in df.collect()}


@pytest.mark.parametrize("name", ["silhouette", "neighborhood_purity", "min_intercluster_distance", "dunn"])
def test_pairwise_indices_in_tiles(spark, clouds, small_tiles, monkeypatch, name):
    index = getattr(indices, name)
    want = values(index(clouds, ["dataset_id"]), "dataset_id")
    monkeypatch.setattr(indices, "MAX_PAIRWISE", 65)  # the larger cloud goes in tiles
    assert values(index(clouds, ["dataset_id"]), "dataset_id") == want
    one = clouds.filter("dataset_id = 0").drop("dataset_id")
    assert values(index(one)) == {(): want[(0,)]}


def test_blocks_hold_each_point_once(spark, clouds):
    blocks = tiles.blocks_of(clouds, ["dataset_id"], size=40).collect()
    ids = np.concatenate([np.frombuffer(b.ids, "<i8") for b in blocks])
    assert sorted(ids) == sorted(r.point_id for r in clouds.collect()) and max(b.n for b in blocks) <= 80 and len(blocks) > 3
    same = spark.createDataFrame([(0, i, 1.0, 2.0, 0) for i in range(300)], POINTS)
    assert max(r.n for r in tiles.blocks_of(same, ["dataset_id"], size=40).collect()) < 100  # equal points are split, too


def test_trees_weigh_as_much_as_prims(spark, clouds, small_tiles):
    from pyspark.sql import functions as F

    cored = clouds.filter("label >= 0").withColumn("core", F.pmod("point_id", F.lit(5)) / 10.0)
    tree = tiles.spanning_edges(cored, ["dataset_id"], 40).toPandas()
    own = cored.toPandas()
    for (d, c), rows in own.groupby(["dataset_id", "label"]):
        got = tree[(tree["dataset_id"] == d) & (tree["label"] == c)]
        rows = rows.sort_values("point_id")
        dist = kernels.distances(rows[["x", "y"]].to_numpy())
        core = rows["core"].to_numpy()
        want = kernels.mst(np.maximum(dist, np.maximum(core[:, None], core[None, :]))) if len(rows) > 1 else []
        assert len(got) == len(rows) - 1
        assert np.allclose(np.sort(got["w"]), np.sort([w for w, _, _ in want]))


def test_density_indices_in_tiles(spark, clouds, small_tiles, monkeypatch):
    names = ["dbcv", "cop", "cvdd", "dcsi", "cdbw", "coggins_jain"]
    want = values(density.density_indices(clouds, ["dataset_id"], names), "dataset_id", "metric_id")
    monkeypatch.setattr(density, "MOST_POINTS", 65)
    assert values(density.density_indices(clouds, ["dataset_id"], names), "dataset_id", "metric_id") == want


def test_shared_neighbour_index_by_hand_and_in_tiles(spark, clouds, small_tiles, monkeypatch):
    x = np.array([[0.0, 0], [1, 0], [10, 0], [11, 0], [12, 0]])
    sep, com = density.cvnn_parts(x, np.array([0, 0, 0, 1, 1]), 1)
    # Of (11, 0) both neighbours are as near, the first is outside; so is that of (10, 0). Pairs of cluster 0: 1, 10, 9.
    assert sep == pytest.approx(1 / 2) and com == pytest.approx(20 / 3 + 1)
    both = clouds.filter("label >= 0").selectExpr("*", "explode(array(1, 2)) as candidate").selectExpr("dataset_id", "candidate", "point_id", "x", "y", "if(candidate = 1, label, label % 2) as label")
    got = lambda: {(r.dataset_id, r.candidate): tuple(None if v is None else round(v, 9) for v in (r.sep, r.com, r.raw)) for r in density.cvnn(both, ["dataset_id"], "candidate").collect()}
    want = got()
    assert len(want) == 4
    monkeypatch.setattr(density, "MOST_POINTS", 65)
    assert got() == want


def test_hdbscan_in_tiles(spark, clouds, small_tiles, monkeypatch):
    want = {(r.dataset_id, r.point_id): r.label for r in search.labels_of(clouds, "hdbscan", {"min_cluster_size": 8}).collect()}
    assert len(set(want.values())) > 2
    monkeypatch.setattr(search, "HDBSCAN_POINTS", 70)
    assert {(r.dataset_id, r.point_id): r.label for r in search.labels_of(clouds, "hdbscan", {"min_cluster_size": 8}).collect()} == want
