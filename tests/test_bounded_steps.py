import json
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from clusterloom.operators import indices, kernels, neighbours, search, shapes, summaries


def test_clouds_are_dealt_to_as_many_tasks_as_shuffles_have(spark):
    plan = json.dumps({"components": [{"id": "a", "shape": "blob", "n": 5}]})
    jobs = spark.createDataFrame([(i, i, plan) for i in range(40)], "dataset_id long, seed long, plan string").coalesce(1)
    assert shapes.generate(jobs).rdd.getNumPartitions() > 1


def test_steps_of_a_broadcast_join_hold_bounded_distances(monkeypatch):
    rng = np.random.default_rng(0)
    ids, x = np.arange(90), np.round(rng.normal(size=(90, 2)), 1)  # equal distances, too
    monkeypatch.setattr(neighbours, "STEP", 450, raising=False)
    batch = pd.DataFrame({"id": ids, "v": list(x)})
    parts = list(neighbours._nearest(SimpleNamespace(value=(ids, x)), 4, "euclidean", True)(iter([batch])))
    assert max(p["query_id"].nunique() for p in parts) <= 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert pd.concat(parts)["neighbour_id"].tolist() == np.stack([np.lexsort((ids, r))[:4] for r in d]).ravel().tolist()


def test_trials_leave_their_cloud_as_it_is():
    x = np.asfortranarray(np.random.default_rng(1).normal(size=(60, 2)))  # the layout of columns of pandas
    before, labels = x.copy(), kernels.optics(x, 5)
    assert (x == before).all() and (labels == kernels.optics(before, 5)).all()


def test_trials_of_large_clouds_are_shared_by_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    clouds = [(d, i, float(a), float(b)) for d in (0, None) for i, (a, b) in enumerate(np.concatenate([rng.normal(c, 0.3, (70, 2)) for c in ((0, 0), (3, 1))]))]
    points = spark.createDataFrame(clouds, "dataset_id int, point_id long, x double, y double")
    space = [("kmeans", {"n_clusters": 2}), ("optics", {"min_samples": 5}), ("hdbscan", {}), ("dbscan", {"eps": 9.0}), ("none", {}), ("kmeans", {"n_clusters": 3})]
    candidates = search.candidate_table(spark, [(i, a, json.dumps(c)) for i, (a, c) in enumerate(space)])
    log = lambda: {(r.dataset_id, r.candidate, r.metric_id): (r.valid, r.n_clusters, r.noise_ratio, r.exception, r.raw and round(r.raw, 9), round(r.norm, 9)) for r in search.run_trials(points, candidates).collect()}
    want = log()
    for name, value in (("TASK_POINTS", 100), ("LARGE_CHUNK", 2), ("PART", 64)):
        monkeypatch.setattr(search, name, value)
    assert log() == want and len(want) == 36
    by_hand = {}
    for i, (a, c) in enumerate(space[:3]):
        x = np.array([r[2:] for r in clouds if r[0] == 0])
        labels = kernels.resolve(a)[0](x, **c)
        by_hand[i] = round(indices.silhouette_kernel(x[labels >= 0], labels[labels >= 0]), 9)
    assert {i: want[0, i, "silhouette"][4] for i in by_hand} == by_hand


def test_silhouettes_by_product_and_by_runs_agree(monkeypatch):
    rng = np.random.default_rng(5)
    x, labels = rng.normal(size=(300, 2)), [rng.integers(-1, 40, 300), rng.integers(0, 3, 300), np.zeros(300, int)]
    want = indices.silhouettes(x, labels)
    for product in (1, 100):
        monkeypatch.setattr(indices, "PRODUCT", product)
        monkeypatch.setattr(indices, "STEPS", (16, 50))
        assert np.allclose(want[:2], indices.silhouettes(x, labels)[:2], atol=1e-12) and want[2] is None
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = labels[1]
    means = np.array([[d[i, (own == c) & (np.arange(300) != i)].mean() for c in range(3)] for i in range(300)])
    a, b = means[np.arange(300), own], np.where(np.arange(3) == own[:, None], np.inf, means).min(1)
    assert np.isclose(want[1], ((b - a) / np.maximum(a, b)).mean())


def test_exact_percentiles_are_those_of_all_values(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), int(b), None if i % 3 else float(c), None, 4.0) for i, (a, b, c) in enumerate(zip(rng.lognormal(0, 4, 5000), rng.integers(0, 4, 5000), rng.normal(size=5000), strict=True))]
    rows += [(float("nan"), 2, -0.5, None, 4.0)] * 7
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double").repartition(5)
    wanted = [(c, at) for c in "abcde" for at in (0.0, 0.25, 0.5, 0.7501, 1.0)]
    got = summaries.exact_percentiles(df, wanted)
    want = list(df.agg(*(summaries.q(c, at) for c, at in wanted)).first())
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (g is None or g == pytest.approx(w, rel=1e-12, nan_ok=True))
    assert summaries.exact_percentiles(df.limit(0), [("a", 0.5)]) == [None]
    plan = neighbours.scaler(df, ["a", "c"])._jdf.queryExecution().toString()
    assert "percentile(" not in plan  # no task gathers all values


def test_parts_of_selections_follow_the_rows(spark, monkeypatch, tmp_path):
    from clusterloom.plans import projections

    rows = [(i // 5, "RNA"[i % 3], "OF"[i % 2], float(i % 7 + 1)) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(projections, "TASK_ROWS", 25, raising=False)
    found = projections.selections(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 16
    usage = {r.metric_id: r for r in summaries.metric_usage(found).collect()}
    pairs = {(o, f + s) for o, f, s, _ in rows}
    assert {m: (r.n_runs, r.n_slots) for m, r in usage.items()} == {m: (n, n) for m in {m for _, m in pairs} for n in [sum(p[1] == m for p in pairs)]}
    assert sum(r.weight_mass for r in usage.values()) == pytest.approx(80) and sum(r.slot_share for r in usage.values()) == pytest.approx(1)
