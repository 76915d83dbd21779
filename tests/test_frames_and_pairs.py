"""Best-view frames, summaries, pairs and portfolios on the planted fixture."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clusterloom.operators import frames, pairing, portfolio, resampling, statistics, summaries

VIEWS = ("x_only", "y_only", "xy_2d")
CELLS = {
    ("d1", "regressor"): ((0.80, 10), (0.80, 4), (0.60, 6)),
    ("d1", "knn"): ((0.70, 5), (0.75, 5), (0.65, 5)),
    ("d1", "silhouette"): ((0.50, 2), (0.55, 2), (0.40, 2)),
    ("d2", "regressor"): ((0.90, 8), (0.85, 8), (0.88, 8)),
    ("d2", "knn"): ((0.95, 6), (0.60, 6), (0.70, 6)),
    ("d2", "silhouette"): ((0.40, 2), (0.45, 2), (0.42, 2)),
    ("d3", "regressor"): ((0.30, 9), (0.35, 9), (0.33, 9)),
    ("d3", "knn"): ((0.40, 7), (0.38, 7), (0.39, 7)),
    ("d3", "silhouette"): ((0.60, 2), (0.20, 2), (0.25, 2)),
    ("d4", "regressor"): ((0.55, 11), (0.50, 11), (0.52, 11)),
    ("d4", "knn"): ((None, 3), (None, 3), (None, 3)),
    ("d4", "silhouette"): ((0.48, 2), (0.44, 2), (0.46, 2)),
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        (d, m, VIEWS[i], i, a, float(t), "failed" if a is None else "success", 3 if a and a > 0.5 else 4, 3, int(d[1]) % 2)
        for (d, m), cells in CELLS.items()
        for i, (a, t) in enumerate(cells)
    ]
    return spark.createDataFrame(rows, "dataset_id string, method_name string, view_id string, view_rank int, ari double, runtime_sec double, status string, selected_k int, true_k int, family int").cache()


@pytest.fixture(scope="module")
def best(runs):
    return frames.best_view_frame(runs).cache()


def test_best_view_and_its_ties(best):
    by = {(r.dataset_id, r.method_name): r for r in best.collect()}
    assert len(by) == 12
    tied = by["d1", "regressor"]
    assert (tied.best_ari, tied.best_view, tied.best_runtime_sec, tied.total_runtime_sec) == (0.80, "y_only", 4.0, 20.0)
    failed = by["d4", "knn"]
    assert failed.best_ari is None and failed.n_success == 0 and failed.total_runtime_sec == 9.0 and failed.family == 0


def test_rows_without_success(runs):
    assert frames.best_view_rows(runs).count() == 11
    kept = frames.collapse_best_view(runs).filter("dataset_id = 'd4' and method_name = 'knn'").collect()
    assert len(kept) == 1 and kept[0].view_id == "x_only"


def test_missing_cells(runs):
    some = runs.filter("not (dataset_id = 'd2' and view_id = 'xy_2d')")
    assert frames.missing_runs(some).count() == 3
    audit = {r.method_name: r for r in summaries.coverage_audit(frames.complete_frame(some)).collect()}
    assert audit["knn"].n_missing == 1 and audit["knn"].n_failed == 3 and audit["knn"].n_success == 8


def test_rank_within_pool(best):
    by = {(r.dataset_id, r.method_name): r for r in frames.dataset_level_frame(best).collect()}
    assert by["d2", "knn"].rank_within_pool == 1 and by["d2", "knn"].is_best
    assert by["d4", "knn"].rank_within_pool is None and not by["d4", "knn"].is_best
    assert abs(by["d1", "knn"].delta_to_best + 0.05) < 1e-12


def test_grouping_sets_equal_single_groupings(runs):
    sets = summaries.standard_summaries(runs)
    one = summaries.summarize_by(runs, ["method_name", "view_id"])
    got = {(r.method_name, r.view_id): (r.n_runs, r.ari_mean) for r in sets.filter("grouping = 'view_id'").collect()}
    assert got == {(r.method_name, r.view_id): (r.n_runs, r.ari_mean) for r in one.collect()}
    assert sets.filter("grouping = ''").count() == 3


def test_pairs_and_win_rates(best):
    pairs = pairing.paired_values(best, "regressor", "knn").orderBy("dataset_id").collect()
    assert [r.dataset_id for r in pairs] == ["d1", "d2", "d3"]
    w = {(r.method, r.baseline): r for r in pairing.winrates(best).collect()}
    assert (w["regressor", "knn"].wins, w["regressor", "knn"].losses) == (1, 2)
    assert w["knn", "regressor"].gain_mean == pytest.approx(-w["regressor", "knn"].gain_mean)
    shares = summaries.win_rates(best).agg(F.sum("wins")).first()[0]
    assert shares == pytest.approx(4)


def test_pareto_and_dominators(spark):
    points = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.4), ("c", 3.0, 0.9), ("d", 3.0, 0.8)], "m string, cost double, gain double")
    assert {r.m for r in pairing.pareto_frontier(points, "cost", "gain").collect()} == {"a", "c"}
    dom = {r.m: r.dominated_by for r in pairing.dominators(points, "m", "cost", "gain").collect()}
    assert dom == {"b": ["a"], "d": ["c"]}


def test_virtual_best_is_the_maximum_and_monotone(best):
    full = {r.dataset_id: r for r in portfolio.virtual_best(best).collect()}
    assert {d: r.winner for d, r in full.items()} == {"d1": "regressor", "d2": "knn", "d3": "silhouette", "d4": "regressor"}
    some = {r.dataset_id: r.vbs_ari for r in portfolio.virtual_best(best, ["knn", "silhouette"]).collect()}
    assert all(full[d].vbs_ari >= v for d, v in some.items())
    assert portfolio.winner_composition(portfolio.virtual_best(best)).agg(F.sum("share")).first()[0] == pytest.approx(1)


def test_greedy_grows_by_the_largest_gain(best):
    steps = portfolio.greedy_portfolio(best).orderBy("step").collect()
    assert [s.method_name for s in steps][0] == "regressor" and len(steps) == 3
    assert steps[-1].portfolio_mean == pytest.approx((0.80 + 0.95 + 0.60 + 0.55) / 4)
    assert all(s.gain >= 0 for s in steps)


def test_representative_and_stability(best):
    r = portfolio.representative(best).first()
    assert r.selected == "regressor" or r.selected_mean >= 0.6
    wins = portfolio.selection_stability(best, draws=50)
    assert wins.agg(F.sum("wins")).first()[0] == 50
    assert sorted(map(tuple, wins.collect())) == sorted(map(tuple, portfolio.selection_stability(best.repartition(3), draws=50).collect()))


def test_signed_ranks_with_zeros_and_ties(spark):
    d = spark.createDataFrame([("a", x) for x in (0.0, 1.0, -1.0, 2.0, 3.0, None)], "k string, delta double")
    r = statistics.signed_rank_p(d, ["k"]).first()
    assert (r.n, r.w_plus, r.w_minus) == (4, 8.5, 1.5) and r.rank_biserial == pytest.approx(0.7) and 0 < r.p_value < 1


def test_corrections_are_monotone(spark):
    t = spark.createDataFrame([("f", f"h{i}", p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5))], "family string, hypothesis string, p_value double")
    holm = [r.p_holm for r in statistics.holm(t, ["family"]).orderBy("p_value").collect()]
    assert holm == pytest.approx([0.04, 0.09, 0.09, 0.5])
    q = [r.q_value for r in statistics.bh_fdr(t, ["family"]).orderBy("p_value").collect()]
    assert q == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_bootstrap_covers_the_mean(spark):
    v = spark.createDataFrame([("a", i, float(i % 7)) for i in range(300)], "k string, unit int, v double")
    r = resampling.bootstrap(v, ["k"], "v", "unit", draws=200).first()
    assert r.low < 3.0 < r.high and r.high - r.low < 1


def test_permutation_finds_planted_groups(spark):
    planted = spark.createDataFrame([(i % 3, float(i % 3) + 0.01 * i) for i in range(60)], "g int, v double")
    assert resampling.permutation(planted, "g", "v").first().p_value < 0.05


def test_registered_resampling_takes_the_protocols_draws(spark, monkeypatch):
    from clusterloom.plans import run_queries

    taken = {}
    best = spark.createDataFrame([(i, m, float(i % 3)) for i in range(4) for m in "ab"], "dataset_id long, method_name string, best_ari double")
    monkeypatch.setattr(run_queries, "_best", lambda s, d: best)
    sums, upto = resampling.resampled_sums, F.sequence
    for name in ("bootstrap_ci", "selection_stability", "random_subset_curve"):
        monkeypatch.setattr(resampling, "resampled_sums", lambda *a, name=name: taken.setdefault(name, a[4]) and sums(*a))
        monkeypatch.setattr(F, "sequence", lambda a, z, name=name: taken.setdefault(name, z) is None or upto(a, z))
        run_queries.QUERIES[name](spark, "")
    curve = spark.range(1).select(taken["random_subset_curve"]).first()[0]
    assert taken["bootstrap_ci"] == 2000 and taken["selection_stability"] == 1000 and curve == 200
