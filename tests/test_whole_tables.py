"""Neighbour queries ask for every row of their table, and the product that finds near rows leaves none out."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from clusterloom.operators import metric_tree, neighbours
from clusterloom.operators.metric_tree import NearestRows, distances_to


def tables(folder, suppliers=9, vectors=23):
    """Small lineitem and embeddings tables; most ids are not divisible by ten."""
    rng = np.random.default_rng(3)
    n = suppliers * 12
    lines = {"l_orderkey": np.arange(n), "l_partkey": np.arange(n) % 7, "l_suppkey": np.arange(n) % suppliers + 1, "l_linenumber": np.ones(n, np.int32)}
    lines |= {"l_quantity": rng.integers(1, 50, n).astype(float), "l_extendedprice": rng.integers(900, 90000, n).astype(float), "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100}
    pd.DataFrame(lines | {"l_returnflag": "A", "l_linestatus": np.where(rng.random(n) < 0.5, "F", "O")}).to_parquet(folder / "lineitem.parquet")
    pd.DataFrame({"vec_id": np.arange(1, vectors + 1), "embedding": list(rng.normal(size=(vectors, 6)).astype("f4")), "label": 0}).to_parquet(folder / "embeddings.parquet")


def answers(spark, folder, name):
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_every_vector_asks_for_utilities(spark, tmp_path):
    tables(tmp_path)
    got, want = answers(spark, tmp_path, "knn_utility_predict")
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert len({r[0] for r in got}) > 15
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)


def test_every_record_asks_for_its_nearest_label(spark, tmp_path):
    tables(tmp_path, suppliers=23)
    got, want = answers(spark, tmp_path, "nearest_label")
    assert len(got) == 23 and [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)


def test_exact_neighbours_without_the_utility_do_not_decide(spark):
    near = spark.createDataFrame([(1, 2, 0.0, 1), (1, 3, 1.0, 2), (1, 4, 3.0, 3)], "query_id long, neighbour_id long, distance double, position int")
    u = spark.createDataFrame([(3, "m", 0.4), (4, "m", 0.8), (2, "z", 0.3), (3, "z", 0.9)], "dataset_id long, metric_id string, utility double")
    got = {r.metric_id: r.utility for r in neighbours.predict_utilities(near, u).collect()}
    assert got == pytest.approx({"m": 0.5, "z": 0.3})


def test_joins_of_empty_tables_are_empty(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert neighbours.knn_join(df, df, 2, "id", "v").count() == 0


def test_ids_may_be_strings(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(80, 3)))], "id string, v array<double>")
    want = {tuple(r) for r in neighbours.knn_join(df, df, 3, "id", "v").collect()}
    assert len(want) == 240 and all(q != r for q, r, *_ in want)
    for name, most in (("DEALT", 10), ("BROADCAST_ROWS", 50)):
        monkeypatch.setattr(neighbours, name, most)
        assert {tuple(r) for r in neighbours.knn_join(df, df, 3, "id", "v").collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 70), st.integers(1, 6), st.sampled_from(["euclidean", "cosine"]), st.sampled_from([0, 1, 8]), st.sampled_from([0.0, 1e6, 1e-160, np.nan]), st.booleans())
def test_near_rows_equal_those_by_definition(seed, n, k, metric, digits, odd, bounded):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(digits) + (1e6 if odd == 1e6 else 0)
    x[rng.integers(0, n)] *= odd
    ids, a = rng.permutation(n), x[rng.integers(0, n, 20)]
    own = ids[rng.integers(0, n, 20)]
    within = np.where(rng.random(20) < 0.5, 0.7, np.inf) if bounded else None
    want = []
    for i in range(20):
        d = np.array([distances_to("cosine", a[i], r[None])[0] if metric == "cosine" else np.sqrt(((r - a[i]) ** 2).sum()) for r in x])
        d = np.where((ids == own[i]) | ~np.isfinite(d), np.inf, d)
        order = [j for j in np.lexsort((ids, d if metric == "euclidean" else d.round(12))) if np.isfinite(d[j]) and (within is None or d[j] <= within[i])][:k]
        want += [(own[i], round(d[j], 9)) + ((ids[j],) if metric == "euclidean" else ()) for j in order]
    got = pd.concat([pd.DataFrame({"query_id": [], "neighbour_id": [], "distance": []}), *NearestRows(ids, x, k, metric, True).steps(own, a, within, most=4 * n)])
    assert [(r.query_id, round(r.distance, 9)) + ((r.neighbour_id,) if metric == "euclidean" else ()) for r in got.itertuples()] == want


def test_rows_that_are_as_near_as_each_other_come_in_slices(monkeypatch):
    monkeypatch.setattr(metric_tree, "PAIRED", 100)
    rows = NearestRows(np.arange(50)[::-1], np.ones((50, 4)), 2, "euclidean", True)
    assert rows.ids.tolist() == [2, 1, 0]  # the others are never among the nearest
    monkeypatch.setattr(NearestRows, "_that_count", staticmethod(lambda ids, x, k: np.arange(len(ids))))
    rows = NearestRows(np.arange(50)[::-1], np.ones((50, 4)), 2, "euclidean", True)
    assert len(rows.ids) == 50
    got = pd.concat(rows.steps(np.arange(5), np.ones((5, 4))))
    assert got["neighbour_id"].tolist() == [1, 2, 0, 2, 0, 1, 0, 1, 0, 1]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_a_tree_that_rules_out_little_gives_way_to_rounds(spark, monkeypatch, metric):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24))
    x[200:240] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for name, value in (("CELL_ROWS", 40), ("ROUND_ROWS", 70), ("TRIED", 32)):
        monkeypatch.setattr(metric_tree, name, value)
    join = metric_tree.TreeJoin(df.filter("id <> 11"), df, 4, "id", "v", metric)
    assert join.rounds == 5
    want = set()
    for q in set(range(300)) - {11}:
        d = distances_to(metric, x[q], x).round(12)
        d[q] = np.inf
        want |= {(q, int(j), r + 1) for r, j in enumerate(np.lexsort((np.arange(300), d))[:4])}
    assert {(r.query_id, r.neighbour_id, r.position) for r in join.found.collect()} == want
