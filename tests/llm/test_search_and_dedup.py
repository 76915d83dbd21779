"""Sharding, top-k, SimHash, near-duplicates and components against brute force."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clusterloom.llm.components import connected_components
from clusterloom.llm.near_duplicates import drop_near_duplicates, near_duplicate_groups
from clusterloom.llm import sharding
from clusterloom.llm.sharding import admitted, balanced_shards, fitted, shard_documents
from clusterloom.llm.simhash import Forest, majority, near_pairs, plan_tree, route, shingle_hashes, simhash_digest
from clusterloom.llm.topk import exact_top_k, top_k_digest
from clusterloom.llm.words import split_words

SCHEMA = "doc_id long, text string"


def reach(ids, linked):
    comp = list(ids)
    moved = True
    while moved:
        moved = False
        for i in range(len(ids)):
            low = min(c for c, near in zip(comp, linked[i], strict=True) if near)
            if low < comp[i]:
                comp[i], moved = low, True
    return comp


def test_shards_are_even_and_keep_groups_together(spark):
    rows = [(i, "same" if i % 3 == 0 else None if i % 7 == 0 else f"pair {i // 2}") for i in range(301)] + [(5, "pair 2"), (5, "pair 2"), (None, "")]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), 16).toPandas()
    assert len(out) == len(rows)
    sizes = out.groupby("shard").size()
    assert set(sizes.index) == set(range(16)) and sizes.max() - sizes.min() <= 1
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    hot = out[out["text_crc32"] == out.loc[out["doc_id"] == 0, "text_crc32"].iloc[0]]
    # A third of all rows needs six shards; it isn't spread over all.
    assert hot["shard"].nunique() <= 10
    pairs = out[out["size"] > 6].groupby("text_crc32")["shard"].nunique()
    assert (pairs == 1).mean() > 0.9


@pytest.mark.parametrize(("groups", "size"), [(2000, 2), (800, 5)])
def test_copies_stay_together_where_every_row_has_one(spark, groups, size):
    rows = [(i, f"text {i % groups}") for i in range(groups * size)]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), 16).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == len(rows) and sizes.max() - sizes.min() <= 1
    # The end of a shard's share splits one group at most.
    assert (out.groupby("text_crc32")["shard"].nunique() > 1).sum() <= 15


def test_only_keys_beyond_a_quota_are_split_among_large_ones(spark):
    rows = [(i, f"large {i % 4}") for i in range(2400)] + [(9000 + i, f"small {i // 2}") for i in range(1600)]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), 4).toPandas()
    shards = out.groupby("text_crc32")["shard"].nunique()
    assert set(out.groupby("shard").size()) == {1000} and (shards > 1).sum() <= 3
    assert all(shards[c] == 1 for c in out.loc[out["doc_id"] < 2400, "text_crc32"].unique())


@pytest.mark.parametrize("size", [2, 4, 10])
def test_propagation_joins_what_the_hash_has_parted(spark, size):
    """Without unlinked rows, so that nothing can move but in exchange."""
    n, shards = 2400 // size * size, 8
    linked = spark.createDataFrame([(f"k{i // size}", i) for i in range(n)], "key string, uid long")
    quotas = [n // shards] * shards
    packed, start, free = sharding.start_cells(linked, quotas)
    assert packed.count() == 0 and free == quotas
    cut, wished = sharding.cut_rows(start), []
    cells = sharding.propagate(start, free, seen=wished)
    assert cut > n * 0.4 and wished[0] == cut and len(wished) > 1 and wished[-1] == 0
    last = sharding.settle(cells, free).toPandas()
    assert last["n"].sum() == n and (last.groupby("shard")["n"].sum() <= n // shards).all()
    assert (last.groupby("key").size() > 1).sum() < shards  # as few as packing leaves
    one = sharding.propagate(start, free, max_rounds=1)
    assert sharding.cut_rows(one) < cut


def test_flows_keep_to_the_quotas():
    share, whole = admitted([[0, 10], [10, 0]], [50, 50], [50, 50], [0, 0])
    assert share == [[1.0, 1.0], [1.0, 1.0]] and whole == [[0, 0], [0, 0]]  # exchanges are free
    share, whole = admitted([[0, 10], [0, 0]], [50, 50], [50, 50], [0, 0])
    assert share[0][1] == pytest.approx(0.0, abs=0.11)  # no room, nothing to swap
    share, whole = admitted([[0, 10], [0, 0]], [50, 50], [50, 50], [0, 40])
    assert share[0][1] == 1.0 and whole == [[0, 0], [10, 0]]  # whole keys go the other way
    share, whole = admitted([[0, 10], [0, 0]], [30, 50], [50, 56], [0, 0])
    assert share[0][1] == pytest.approx(0.6, abs=0.11)


def test_last_keys_fit_whole_where_they_can():
    moves = fitted({0: [("a", 5), ("b", 3), ("c", 2)]}, [5, 0, 0], [0, 3, 2])
    assert sorted(moves) == [("b", 0, 1, 3), ("c", 0, 2, 2)]
    moves = fitted({0: [("a", 5)]}, [3, 0], [0, 9])
    assert moves == [("a", 0, 1, 3)]


def test_rows_equal_in_everything_spread(spark, monkeypatch):
    df = spark.createDataFrame([(None, "same")] * 900 + [(i, None) for i in range(100)], "id long, key string")
    out = balanced_shards(df, 4).toPandas()
    assert sorted(out.groupby("shard").size()) == [250] * 4
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(250))


def test_sharding_equals_its_contract_by_brute_force(spark):
    """Size, checksum, gapless slots and even counts of each document, by plain Python."""
    import zlib

    texts = ["é" * 3, "", None, "same", "same", "x" * 1000] * 7
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), 16).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows") for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in out) == want
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))


def test_shards_of_an_empty_table_and_clashing_columns(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "a", 9, 9), (2, "a", 9, 9)], "id long, key string, shard int, slot int")
    out = balanced_shards(rows, 2).toPandas()
    assert sorted(out["shard"]) == [0, 1] and set(out.columns) == {"id", "key", "shard", "slot"}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    out = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in range(100, 140)} == {100}
    assert out[200] == 200 and out[301] == 300
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprint_by_definition():
    hashes = shingle_hashes(b"The quick\tbrown FOX\njumps", 3, 42)
    assert len(hashes) == 3 and shingle_hashes(b"one Two", 3, 42) == shingle_hashes(b"ONE two", 3, 42)
    assert shingle_hashes(None, 3, 42) == shingle_hashes(b" \n", 3, 42) == []
    got = int(majority(np.array(hashes, np.uint64), np.array([0]))[0])
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert got == want


def test_xxh64_is_the_engines_own(spark):
    text = "alpha beta gamma"
    own = spark.sql(f"select xxhash64('{text}') as h").first().h
    assert own & (2**64 - 1) == shingle_hashes(text.encode(), 3, 42)[0]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(0, 6))
def test_trees_lose_no_pair(seed, n, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)
    points = base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    wanted = {(i, j) for i in range(n) for j in range(n) if bin(int(points[i] ^ points[j])).count("1") <= radius}
    every = np.arange(n)
    assert {(a, b) for q, p in near_pairs(points, every, every, radius) for a, b in zip(q.tolist(), p.tolist(), strict=True)} == wanted
    tree = {a: (v, m) for a, v, m in plan_tree(points, 3, radius)}
    index, shard, home = route(points, tree, radius)
    lives = dict(zip(index[home].tolist(), shard[home].tolist(), strict=True))
    visits = set(zip(index.tolist(), shard.tolist(), strict=True))
    for i, j in wanted:  # every pair meets in a shard where one of the two lives
        assert (i, lives[j]) in visits or (j, lives[i]) in visits


def test_forest_links_all_pairs():
    forest = Forest(6)
    forest.link(np.array([0, 2, 4, 1]), np.array([1, 3, 5, 3]))
    assert forest.roots().tolist() == [0, 0, 0, 0, 4, 4]


def test_simhash_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(30)]
    texts = [*base, *(b + " tail" for b in base[:12]), *base[:5], None, "", "  ", "short", "two words", "very " * 5000]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    out = simhash_digest(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("doc_id")
    ids = [i for i, _ in rows]
    prints = []
    for _, t in rows:
        h = shingle_hashes(t.encode() if t else None, 3, 42)
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert [out.loc[i, "fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    linked = [[bin(a ^ b).count("1") <= 3 for b in prints] for a in prints]
    assert [out.loc[i, "component_id"] for i in ids] == reach(ids, linked)


def test_simhash_with_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, None)]
    out = simhash_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def shingles(text, width=5):
    w = split_words(text.encode())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_near_duplicates_follow_jaccard(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for i in range(40):
        own = list(rng.choice(words, 150))
        texts.append(" ".join(own))
        if i % 2:
            copy = own.copy()
            copy[70] = "changed"
            texts.append(" ".join(copy))  # similarity about 0.93
        if i % 5 == 0:
            texts.append(" ".join(own[:75] + list(rng.choice(words, 75))))  # about 0.3: not a duplicate
    texts += [texts[0], "", "  ", None]
    rows = list(enumerate(texts))
    groups = {r.key: r.group for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), F.col("doc_id")).collect()}
    sets = [shingles(t or "") for t in texts]
    linked = [[(len(a & b) / len(a | b) if a | b else 1.0) >= 0.8 for b in sets] for a in sets]
    assert [groups[i] for i, _ in rows] == reach([i for i, _ in rows], linked)


def test_a_crowded_meeting_is_compared_in_blocks(spark, monkeypatch):
    from clusterloom.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rng = np.random.default_rng(6)
    own = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = own.copy()
        copy[int(rng.integers(120))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    out = near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), F.col("doc_id")).collect()
    assert {r.group for r in out} == {0}


def test_repeats_within_a_text_hide_no_near_duplicate(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(30):
        own, line = list(rng.choice(words, 300)), list(rng.choice(words, 10))
        times = (10, 30)[i % 2]
        texts += [" ".join(own + line * 2), " ".join(own + line * times)]  # equal sets, other counts
        texts.append(" ".join(own[:1] + ["new"] + own[2:] + line * times))  # a set of 0.97 or so
    groups = {r.key: r.group for r in near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), SCHEMA), F.col("doc_id")).collect()}
    assert groups == {i: i - i % 3 for i in range(len(texts))}


def test_pairs_at_the_least_similarity_all_meet(spark):
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(5000)]
    rows, stock = [], " ".join(f"s{i}" for i in range(6))  # a line that all texts share
    for i in range(400):
        own = " ".join(rng.choice(words, 30))
        rows += [(2 * i, f"{own} {stock}"), (2 * i + 1, f"{own} {stock} " + " ".join(rng.choice(words, 8)))]  # 32 of 40 shingles
    groups = {r.key: r.group for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), F.col("doc_id")).collect()}
    assert groups == {i: i - i % 2 for i, _ in rows}


def brute_groups(rows, least=0.8):
    """Group of each id by comparing every pair of sets that share a shingle."""
    by_set = {}
    for i, t in rows:
        by_set.setdefault(frozenset(shingles(t or "")), []).append(i)
    sets = list(by_set)
    parent, having = list(range(len(sets))), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in having.get(g, ()))
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= least:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in s:
            having.setdefault(g, []).append(i)
    first = {}
    for i, s in enumerate(sets):
        first[find(i)] = min(first.get(find(i), min(by_set[s])), min(by_set[s]))
    return {d: first[find(i)] for i, s in enumerate(sets) for d in by_set[s]}


def test_groups_of_edited_texts_equal_brute_force(spark):
    """Families of edits at all distances, short texts of nine words among them, and lines that many texts share."""
    rng = np.random.default_rng(12)
    words, lines = [f"w{i}" for i in range(4000)], [" ".join(f"l{j}x{i}" for i in range(12)) for j in range(5)]
    texts = []
    for i in range(150):
        own = list(rng.choice(words, int(rng.choice([9, 30, 120, 700]))))
        for edits in (0, 1, 1, 2, 4, 8, 16):
            copy = own.copy()
            for at in rng.integers(0, len(copy), edits):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy) + (" " + lines[i % 5]) * int(rng.integers(0, 4)))
    rows = list(enumerate(texts))
    got = {r.key: r.group for r in near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), F.col("doc_id")).collect()}
    want = brute_groups(rows)
    assert got == want and 300 < len(set(want.values())) < len(rows)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables here")
def test_groups_of_ten_thousand_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r.key: r.group for r in near_duplicate_groups(docs, F.col("doc_id")).collect()}
    assert got == brute_groups([tuple(r) for r in docs.collect()])


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text, "x"), (3, text, "x"), (1, text + " more", "y"), (None, text, "z"), (9, "something else entirely here now", "q"), (None, None, None)]
    out = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    assert sorted((str(r.doc_id), r.row) for r in out) == [("1", "y"), ("9", "q"), ("None", None)]


def brute_top_k(rows, k, step):
    ok = [(i, [np.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % step == 0:
            scored = sorted((-int(sum(x * y for x, y in zip(a, b, strict=False))), i) for m, (i, b) in enumerate(ok) if m != n)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    from clusterloom.llm import topk

    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(250)]
    rows += rows[100:130]  # repeated rows
    rows += [(i, [0.5] * 6) for i in range(250, 320)] + [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k_digest(df).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, 5, 50)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, top_k_digest(df).collect()))
    assert got == [(0, 1, 50, 256 * 512), (0, 2, 50, 256 * 512), *[(50, 1, 50, 512 * 512)] * 2, *[(50, 2, 0, 256 * 512)] * 2]
    assert top_k_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_top_k_with_another_k(spark, k):
    rows = [(i, [float(i % 5), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 10 == 0, k).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, k, 10)
