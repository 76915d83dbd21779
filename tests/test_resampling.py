"""Bootstraps and permutations that are split over buckets equal what one task would draw, in law."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clusterloom.operators import resampling
from clusterloom.operators.resampling import bootstrap, labels_of, permutation, picks_of, resampled_sums, winners


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(0, 1000))
def test_picks_and_labels_sum_to_the_whole(sizes, seed):
    sizes = np.array(sizes)
    picks = sum(picks_of(b, sizes, 20, [seed, 5]) for b in range(len(sizes)))
    assert (picks == sizes.sum()).all()
    groups = np.array([sizes.sum() // 3, sizes.sum() - sizes.sum() // 3])
    labels = [labels_of(b, sizes, groups, 10, [seed, 5]) for b in range(len(sizes))]
    assert all((x.sum(1) == n).all() for x, n in zip(labels, sizes, strict=True)) and (sum(labels) == groups).all()


def test_picks_are_multinomial():
    sizes = np.array([10, 30, 20])
    picks = np.array([picks_of(b, sizes, 20_000, [3, 1]) for b in range(3)])
    assert np.allclose(picks.mean(1), sizes, atol=0.1) and np.allclose(picks.var(1), 60 * (sizes / 60) * (1 - sizes / 60), rtol=0.05)
    assert np.corrcoef(picks)[0, 1] == pytest.approx(-np.sqrt(10 * 30 / (50 * 30)), abs=0.03)


def grouped(rng, units, rows):
    unit = rng.integers(0, units, rows)
    return unit, rng.normal(0, 1, rows) + rng.normal(0, 1, units)[unit]


def test_interval_ends_equal_numpys_within_monte_carlo_error(spark, monkeypatch):
    monkeypatch.setattr(resampling, "UNITS", 16)
    monkeypatch.setattr(resampling, "FAN", 2)
    rng = np.random.default_rng(5)
    unit, v = grouped(rng, 90, 400)
    rows = [("a", int(u), float(x)) for u, x in zip(unit, v, strict=True)] + [("b", 1, 5.0), (None, 1, 2.0), ("a", 3, None)]
    df = spark.createDataFrame(rows, "k string, unit int, v double")
    got = {r.k: (r.low, r.high) for r in bootstrap(df, ["k"], "v", "unit", draws=10_000).collect()}
    assert got["b"] == (5.0, 5.0) and got[None] == (2.0, 2.0)
    sums, counts = np.bincount(unit, v), np.bincount(unit)
    have = np.flatnonzero(counts)
    pick = rng.choice(have, (10_000, len(have)))
    means = sums[pick].sum(1) / counts[pick].sum(1)
    # The standard error of a 2.5% quantile of 10,000 draws is some 0.03 standard deviations; 4 of them.
    assert np.allclose(got["a"], np.quantile(means, [0.025, 0.975]), atol=0.12 * means.std())
    again = {r.k: (r.low, r.high) for r in bootstrap(df.repartition(7), ["k"], "v", "unit", draws=10_000).collect()}
    assert again["a"] == pytest.approx(got["a"])


def test_each_draw_picks_as_many_units_as_there_are(spark, monkeypatch):
    monkeypatch.setattr(resampling, "UNITS", 8)
    df = spark.createDataFrame([(i, s, 1.0) for i in range(50) for s in "xy"], "unit int, s string, v double")
    rows = resampled_sums(df, [], "v", "unit", 30, 1, "s").collect()
    x, y = (np.frombuffer(r.sums, "<f8") for r in sorted(rows, key=lambda r: r.s))
    assert (x == 50).all() and (x == y).all()  # both series have one row a unit and share the picks


def test_winners_share_the_draws(spark, monkeypatch):
    monkeypatch.setattr(resampling, "UNITS", 8)
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 40), rng.normal(0.15, 1, 40)
    df = spark.createDataFrame([("g", i, m, float(v)) for m, w in (("a", a), ("b", b), ("c", a)) for i, v in enumerate(w)], "g string, d int, m string, v double")
    got = {r.m: r.win_share for r in winners(df, ["g"], "m", "v", "d", 4000).collect()}
    pick = rng.integers(0, 40, (20_000, 40))
    want = (a[pick].mean(1) >= b[pick].mean(1)).mean()
    assert set(got) <= {"a", "b"} and sum(got.values()) == 1  # ties of a and c go to a
    assert got.get("a", 0.0) == pytest.approx(want, abs=0.03)


def test_permutation_p_values(spark, monkeypatch):
    monkeypatch.setattr(resampling, "UNITS", 16)
    rng = np.random.default_rng(9)
    g, v = np.repeat([0, 1, 2, 3], 30), rng.normal(0, 1, 120)
    v[:30] += 0.5
    v[40:110] = 0.25  # a value that most rows hold
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v, strict=True)] + [(None, 1.0), (1, None)], "g int, v double")
    row = permutation(df, "g", "v", 2000).first()

    def between(codes):
        n = np.bincount(codes)
        return (n * (np.bincount(codes, v) / n - v.mean()) ** 2).sum() / len(v)

    assert row.between == pytest.approx(between(g))
    want = np.mean([between(rng.permutation(g)) >= between(g) for _ in range(4000)])
    assert row.p_value == pytest.approx(want, abs=0.03)


def test_permutation_within_families(spark):
    """Groups differ between families only: within them labels make no difference."""
    rng = np.random.default_rng(1)
    rows = [(f, f * 10 + s, float(f * 5 + rng.normal())) for f in range(3) for s in range(3) for _ in range(15)]
    df = spark.createDataFrame(rows, "f int, s int, v double")
    assert permutation(df, "s", "v", 500).first().p_value < 0.01
    inside = permutation(df, "s", "v", 500, within=["f"]).first()
    assert inside.p_value > 0.02 and inside.between > 1
    assert permutation(df.limit(0), "s", "v").count() == 0


def test_the_list_of_bucket_sizes_comes_once_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(resampling, "UNITS", 8)
    rows = spark.createDataFrame([(k, i, 1) for k in ("a", None) for i in range(60) for _ in range(3)], "k string, unit int, w int")
    found = resampling._bucketed(rows, ["k"], "unit", "w").toPandas()
    heads = found[found["sizes"].notna()]
    assert len(found) == 360 + len(heads) and heads["unit"].isna().all()
    for k in ("a", None):
        own = heads[heads["k"].isna() if k is None else heads["k"] == k]
        assert len(own) == own["bucket"].nunique() == len(own["sizes"].iloc[0]) and sum(s["n"] for s in own["sizes"].iloc[0]) == 60
