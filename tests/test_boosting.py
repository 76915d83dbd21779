"""Histogram boosting: equal to a plain loop, with missing values, leaf-wise order, in one task and in passes."""

from __future__ import annotations

import numpy as np
import pytest

from clusterloom.operators import boosting, models
from clusterloom.operators.boosting import Settings, best_split, binned, fit, histograms

COLUMNS = ["a", "b", "c"]


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack((rng.normal(size=n), rng.integers(0, 5, n), rng.uniform(size=n))).astype(float)
    x[rng.random(n) < 0.15, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]), 2.0, np.sin(2 * np.nan_to_num(x[:, 0]))) + 0.3 * x[:, 1] + rng.normal(0, 0.1, n)
    return x, y


def frame(spark, x, y):
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(4)


def plain(x, y, edges, s):
    """Boosting written out row by row of decisions: each leaf keeps its rows; every split is tried in full."""
    missing, predicted = s.bins, np.full(len(y), y.mean())
    b = binned(x, edges, missing).astype(int)
    out = []
    for _ in range(s.iterations):
        leaves = [np.arange(len(y))]
        g = predicted - y

        def tries(own, g=g):
            best = (0.0, None)
            for f in range(b.shape[1]):
                known, lost = own[b[own, f] != missing], own[b[own, f] == missing]
                for k in np.unique(b[known, f]) if len(known) else []:
                    for side in (False, True) if len(lost) else (False,):
                        left = known[b[known, f] <= k]
                        left = np.concatenate([left, lost]) if side else left
                        right = np.setdiff1d(own, left)
                        if min(len(left), len(right)) >= s.least_rows:
                            gain = sum(g[p].sum() ** 2 / (len(p) + s.l2) for p in (left, right)) - g[own].sum() ** 2 / (len(own) + s.l2)
                            if gain > best[0] + 1e-9:
                                best = (gain, (left, right))
            return best

        options = [tries(leaves[0])]
        while len(leaves) < s.leaves and max(o[0] for o in options) > 1e-12:
            at = int(np.argmax([o[0] for o in options]))
            left, right = options.pop(at)[1]
            leaves.pop(at)
            leaves += [left, right]
            options += [tries(left), tries(right)]
        predicted = predicted.copy()
        for own in leaves:
            predicted[own] -= s.rate * g[own].sum() / (len(own) + s.l2)
        out.append(predicted)
    return out


def test_boosting_equals_a_plain_loop(spark):
    x, y = rows_of(400)
    s = Settings(iterations=4, leaves=6, bins=16, rate=0.3)
    model = fit(frame(spark, x, y), COLUMNS, "y", s)
    assert len(model.trees) == 4 and all(len([f for f in t.feature if f < 0]) <= 6 for t in model.trees)
    assert np.allclose(model.predict(x), plain(x, y, model.edges, s)[-1])


def test_passes_equal_one_task(spark, monkeypatch):
    x, y = rows_of(5000, 1)
    df = frame(spark, x, y)
    s = Settings(iterations=4, leaves=12)
    one = fit(df, COLUMNS, "y", s)
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 300)
    monkeypatch.setattr(boosting, "REWRITE", 2)
    many = fit(df, COLUMNS, "y", s)
    assert np.allclose(one.predict(x), many.predict(x)) and many.start == pytest.approx(y.mean())


def test_boosting_learns_and_knows_missing_values(spark):
    x, y = rows_of(4000, 2)
    model = fit(frame(spark, x[:3000], y[:3000]), COLUMNS, "y", Settings(iterations=60))
    held = model.predict(x[3000:])
    assert np.mean((held - y[3000:]) ** 2) < 0.1 * y.var()
    lost = np.isnan(x[3000:, 0])
    assert abs(held[lost] - y[3000:][lost]).mean() < 0.2
    out = model.transform(frame(spark, x[3000:3010], y[3000:3010])).toPandas()
    assert np.allclose(np.sort(out["predicted"]), np.sort(held[:10]))


def test_splits_by_hand():
    s = Settings(bins=3, least_rows=2, l2=0.0)
    x = np.array([[0], [0], [1], [1], [3], [3]], np.uint8)  # 3: missing
    g = np.array([1.0, 1.0, -1.0, -1.0, -1.0, -1.0])
    h = histograms(x, g, np.zeros(6, int), [0], 3)[0]
    gain, f, last, missing_left = best_split(h, s)
    # Left: two rows of 1; right: four of -1. 4/2 + 16/4 - 4/6.
    assert (f, last, missing_left) == (0, 0, False) and gain == pytest.approx(2 + 4 - 4 / 6)
    assert best_split(h, Settings(bins=3, least_rows=4, l2=0.0)) is None


def test_reranker_uses_the_protocols_settings(spark):
    x, y = rows_of(300, 3)
    scored = models.fit_reranker(frame(spark, x, y), COLUMNS, target="y", iterations=5)(frame(spark, x, y))
    assert "predicted_regret" in scored.columns and scored.filter("predicted_regret is null").count() == 0
    empty = fit(frame(spark, x, y).limit(0), COLUMNS, "y", Settings(iterations=2))
    assert empty.predict(x[:3]).tolist() == [0.0, 0.0, 0.0]
