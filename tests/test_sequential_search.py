"""Sequential search: equal to its plain loop, better than random, resumable; user indices; time limits."""

from __future__ import annotations

import json
import math
import time

import numpy as np
import pytest

from clusterloom.operators import kernels, search, sequential
from clusterloom.operators.sequential import Choice, Range, dimension, dimensions, is_good, run_search, search_cloud, suggest

POINTS = "dataset_id long, point_id long, x double, y double"
SPACE = {"kmeans": {"n_clusters": {"type": "int", "low": 2, "high": 9}}, "dbscan": {"eps": {"type": "float", "low": 0.01, "high": 1.0, "log": True}, "min_samples": (3, 5, 10)}, "agglomerative": {"n_clusters": {"type": "int", "low": 2, "high": 9}, "linkage": {"type": "categorical", "choices": ["ward", "average"]}}}


def clouds(n=3, size=25):
    rng = np.random.default_rng(4)
    return [(d, i, float(x), float(y)) for d in range(n) for i, (x, y) in enumerate(np.concatenate([rng.normal(c, 0.08, (size, 2)) for c in rng.uniform(0, 2, (4, 2))]))]


def trials(df):
    rows = df.select("dataset_id", "candidate", "algorithm", "config", "objective").distinct().collect()
    return sorted((r.dataset_id, r.candidate, r.algorithm, r.config, round(r.objective, 12)) for r in rows)


def test_search_equals_its_plain_loop_and_goes_on_from_its_log(spark):
    rows = clouds()
    df = spark.createDataFrame(rows, POINTS).repartition(5)
    whole = run_search(df, SPACE, 24, seed=3)
    got = trials(whole)
    weights = dict.fromkeys(("silhouette", "neighborhood_purity", "min_intercluster_distance"), 1.0)
    want = []
    for d in range(3):
        x = np.array([r[2:] for r in rows if r[0] == d])
        run = search_cloud(x, (d,), dimensions(SPACE), weights, 24, 3, search.evaluator(tuple(weights)))
        want += [(d, t["candidate"], t["algorithm"], t["config"], round(t["objective"], 12)) for t in run]
    assert got == sorted(want) and len(got) == 72
    first = spark.createDataFrame(whole.filter("candidate <= 11").collect(), whole.schema)
    assert trials(run_search(df, SPACE, 24, seed=3, log=first)) == [t for t in got if t[1] > 11]


def quadratic(target):
    """A search problem whose objective falls with the distance to one configuration."""

    def evaluate(x, name, config):
        near = {"a": lambda c: 1 - abs(c["u"] - target) - 0.02 * abs(c["k"] - 7), "b": lambda c: 0.3 * (c["v"] == "q")}[name](config)
        return {"norms": {"m": near}, "valid": True}

    return evaluate


def test_parzen_beats_random_at_fifty_trials():
    space = {"a": {"u": {"type": "float", "low": 0.0, "high": 1.0}, "k": {"type": "int", "low": 1, "high": 30}}, "b": {"v": ("p", "q", "r")}}
    best = {"tpe": [], "random": []}
    for target in (0.15, 0.5, 0.83):
        for seed in range(6):
            for sampler in best:
                run = search_cloud(np.zeros((1, 2)), (target,), dimensions(space), {"m": 1.0}, 50, seed, quadratic(target), sampler)
                best[sampler].append(np.mean([t["objective"] for t in run[-20:]]))
    assert np.mean(best["tpe"]) > np.mean(best["random"]) + 0.2 and (np.array(best["tpe"]) > np.array(best["random"])).mean() > 0.9


def test_search_of_clouds_beats_random(spark):
    df = spark.createDataFrame(clouds(), POINTS)
    mean = {s: np.mean([t[4] for t in trials(run_search(df, SPACE, 50, seed=1, sampler=s)) if t[4] > -1]) for s in ("tpe", "random")}
    assert mean["tpe"] > mean["random"]


def test_densities_by_hand():
    c = Choice(("p", "q"))
    assert c.weights(["p", "p", "q"]).tolist() == [2.5 / 4, 1.5 / 4]
    r = Range(0.0, 1.0)
    centre, wide = r.mixture([0.2, 0.5])
    assert centre.tolist() == [0.2, 0.5, 0.5] and np.allclose(wide, [0.3, 0.5, 1.0])
    at = np.linspace(0, 1, 20_001)
    assert abs(np.trapezoid(np.exp(r.log_density(at, [0.2, 0.5])), at) - 1) < 1e-6  # a density: its integral is 1
    whole = Range(2, 9, step=1)
    assert abs(np.exp(whole.log_density(np.arange(2.0, 10.0), [3, 3, 8])).sum() - 1) < 1e-9
    assert is_good([1, 5, 3, 5]).tolist() == [False, True, False, False] and is_good([0.0] * 400).sum() == 25


def test_dimensions_of_all_kinds():
    assert dimension({"type": "int", "low": 3, "high": 3}) == Choice((3,)) and dimension((1, 2)) == Choice((1, 2)) and dimension("ward") == Choice(("ward",))
    assert dimension({"type": "int", "low": 1, "high": 9, "step": 2}) == Range(1, 9, 2)
    assert {Range(1, 9, 2).uniform(np.random.default_rng(i)) for i in range(200)} == {1, 3, 5, 7, 9}
    rng = np.random.default_rng(0)
    drawn = [Range(0.01, 1.0, log=True).suggest([0.1, 0.12], [0.9, 0.02], rng) for _ in range(50)]
    assert all(0.01 <= v <= 1 for v in drawn) and 0.05 < np.median(drawn) < 0.3
    for bad in ({"type": "date"}, ()):
        with pytest.raises(ValueError):
            dimension(bad)
    with pytest.raises(ValueError):
        dimensions({})
    name, config = suggest(dimensions(SPACE), [("kmeans", {"n_clusters": 4}, float(i == 3)) for i in range(12)], rng)
    assert set(config) == set(SPACE[name])


def test_patience_and_failures():
    run = search_cloud(np.zeros((1, 2)), (1,), dimensions({"a": {"v": (1, 2)}}), {"m": 1.0}, 50, 0, lambda x, n, c: {"norms": {"m": 0.0}, "valid": False}, patience=4)
    assert len(run) == 5 and {t["objective"] for t in run} == {sequential.FAILURE}


def test_a_users_index_ranks_trials(spark, monkeypatch):
    monkeypatch.setattr(search, "METRICS", dict(search.METRICS))
    search.register_index("few_clusters", lambda x, labels: float(len(np.unique(labels))), lambda v: v / 10, higher_is_better=False)
    candidates = search.candidate_table(spark, [(i, "kmeans", json.dumps({"n_clusters": 2 + i})) for i in range(1, 5)])
    df = spark.createDataFrame(clouds(2), POINTS)
    log = search.run_trials(df, candidates, metrics=("few_clusters",))
    assert {(r.candidate, round(r.norm, 6)) for r in log.collect()} == {(i, round(1 - (2 + i) / 10, 6)) for i in range(1, 5)}
    assert {r.candidate for r in search.best_trials(log).collect()} == {1}
    found = run_search(df, {"kmeans": {"n_clusters": {"type": "int", "low": 2, "high": 9}}}, 12, weights={"few_clusters": 1.0})
    assert {r.metric_id for r in found.select("metric_id").distinct().collect()} == {"few_clusters"}


def sleepy(x, naps=30):
    time.sleep(naps)
    return np.zeros(len(x))


def test_a_hanging_kernel_becomes_a_failed_row(spark, monkeypatch):
    monkeypatch.setattr(kernels, "ALGORITHMS", dict(kernels.ALGORITHMS))
    kernels.register("sleepy", sleepy)
    kernels.register("broken", lambda x: 1 / 0)
    candidates = search.candidate_table(spark, [(1, "sleepy", "{}"), (2, "kmeans", '{"n_clusters": 3}'), (3, "broken", "{}")])
    began = time.time()
    log = {r.candidate: r for r in search.run_trials(spark.createDataFrame(clouds(1), POINTS), candidates, metrics=("silhouette",), seconds=3).collect()}
    assert time.time() - began < 25
    assert not log[1].valid and "no labels after 3 s" in log[1].exception and log[1].norm == 0
    assert log[2].valid and log[2].exception is None and "ZeroDivisionError" in log[3].exception
    assert search.within(5, lambda: np.arange(3)).tolist() == [0, 1, 2] and math.isclose(search.within(None, lambda: 1.5), 1.5)
