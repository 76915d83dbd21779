"""Ranked search, sorted projection passes and fill-in-the-middle against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clusterloom.llm import fill_middle, projection_dedup, ranked_search
from clusterloom.llm.fill_middle import cut_points, fill_digest, fill_in_middle, line_starts, ranked_bit, restore, transform
from clusterloom.llm.projection_dedup import linked_vectors, passes_for
from clusterloom.llm.ranked_search import best_of, build_index, search

# --- ranked search -------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    words = [(i, terms_of(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df, out = Counter(t for _, w in words for t in set(w)), []
    for item, text in items:
        scores = []
        for at, (i, w) in enumerate(words):
            tf, m = Counter(w), 50 + (50 * len(w) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(terms_of(text)) if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, at, i))
        out += [(item, r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_bytes", "query_bytes"), [(60, 10**6), (10**6, 40)])
def test_search_equals_brute_force_over_shards_blocks_and_ties(spark, shard_bytes, query_bytes):
    rng = np.random.default_rng(3)
    vocabulary = ["Apple", "pear", "plum", "fig", "Quince", "öl", "x1"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 9)))) for i in range(120)]
    docs += [(500 + i, "pear fig") for i in range(30)] + [(7, None), (8, ""), (9, " ,.; "), (None, "quince plum")]
    items = [(1, "apple, PEAR!"), (2, "plum plum fig"), (3, "absent"), (4, None), (5, ""), (6, "Öl x1 quince"), (2, "fig")]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_bytes=shard_bytes)
    got = search(index, spark.createDataFrame(items, "item_id long, text string"), 10, query_bytes=query_bytes).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(docs, items, 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-2, 4), st.integers(0, 6)), max_size=60), st.integers(1, 12))
def test_best_rows_are_tie_safe(rows, k):
    scores, ids = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    want = sorted((-s, i, at) for at, (s, i) in enumerate(rows) if s > 0)[:k]
    assert best_of(scores, ids, k).tolist() == [at for _, _, at in want]


def test_search_of_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    empty = search(build_index(spark.createDataFrame([], docs)), spark.createDataFrame([(1, "a")], items))
    assert empty.count() == 0
    assert search(build_index(spark.createDataFrame([(1, "a")], docs)), spark.createDataFrame([], items)).count() == 0
    # A term that all documents hold has weight floor(1000 ln(4 / 3)).
    assert ranked_search.term_weight(1, 1) == 287


# --- sorted projection passes --------------------------------------------------------------------


def plain_links(rows, least=0.9):
    width = max((len(v) for _, v in rows if v), default=1)
    usable = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    m = np.array([np.pad(np.array(v if u else [1.0], float), (0, width - len(v if u else [1.0]))) for (_, v), u in zip(rows, usable, strict=True)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= least) & np.outer(usable, usable)
    np.fill_diagonal(near, False)
    comp = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            low = min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))])
            if low < comp[i]:
                comp[i], moved = low, True
    ids = [r[0] for r in rows]
    least_id = {c: min([i for i, d in zip(ids, comp, strict=True) if d == c and i is not None], default=None) for c in comp}
    return sorted(((ids[i], int(near[i].sum()), least_id[comp[i]], ids[i] == least_id[comp[i]]) for i in range(len(rows))), key=str)


def cloud(seed, groups, size, noise, width=16):
    rng = np.random.default_rng(seed)
    return [c + noise * rng.standard_normal(width) for c in rng.standard_normal((groups, width)) for _ in range(size)]


@pytest.mark.parametrize(("groups", "size", "noise"), [(60, 3, 0.15), (3, 70, 0.25), (2, 90, 0.45)])
def test_links_equal_brute_force(spark, monkeypatch, groups, size, noise):
    """Windows, borders, whole and large components: blocks and windows are far smaller than in production."""
    monkeypatch.setattr(projection_dedup, "BLOCK", 16)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(cloud(5, groups, size, noise))]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, [0.0] * 16), (1003, None), (1004, [None] + [1.0] * 15), (None, rows[1][1]), (1005, []), (1006, [float("nan")] * 16), (0, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, linked_vectors(df, window=8, whole=20, recall=0.9999).collect()), key=str)
    assert got == plain_links(rows)


def test_classes_of_large_components_lose_and_add_nothing(spark, monkeypatch):
    """Every pair of a spread-out component is judged once, by the triangle inequality or by its cosine."""
    monkeypatch.setattr(projection_dedup, "BLOCK", 32)
    rng = np.random.default_rng(1)
    angles = np.sort(rng.uniform(0, 2.2, 300))  # a chain: neighbours link, its ends don't
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, linked_vectors(df, whole=10).collect()), key=str) == plain_links(rows)


def test_vectors_of_an_empty_table_and_with_large_components(spark):
    schema = "vec_id long, embedding array<float>, node long, data string, label int"
    assert linked_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1e38, 1e38], 0, "x", 0), (2, [1e38, 1e38], 0, "x", 0), (3, [1e-38, -1e-38], 0, "x", 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in linked_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}


def test_passes_follow_from_the_number_of_vectors():
    assert passes_for(500, 64, 0.9, 0.99) < passes_for(50_000, 64, 0.9, 0.99) < passes_for(5_000_000, 64, 0.9, 0.99)


# --- fill-in-the-middle --------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from(["a", "é", "漢字", "\n", "\n\n", "<P>", "<", "S>", "🙂 x", "\r\n", "<M", ">"]), max_size=25).map("".join)


def plain_cut(text, doc_id):
    h = [int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(PIECES, st.integers(0, 10**6))
def test_cuts_equal_the_definition_and_restore(text, doc_id):
    h = [int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n, form, before, middle, output = transform(text.encode(), tuple(h), 100, 50)
    assert (n, form, before, middle, output.decode()) == plain_cut(text, doc_id)
    assert restore(output, form) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 2**200))
def test_ranked_bits(bits):
    places = [i for i in range(bits.bit_length()) if bits >> i & 1]
    assert [ranked_bit(bits, k) for k in range(len(places))] == places


def test_line_starts_and_cuts_by_hand():
    assert line_starts(b"ab\nc\n") == 0b01001 and line_starts(b"\n\n") == 0b11 and line_starts(b"") == 0
    assert cut_points(b"ab\nc\n", (5, 1)) == (2, 3, 5)  # 5 % 3 = 2 units, 1 unit


def test_fill_in_middle_of_hard_rows(spark):
    long = "line of text\n" * 50_000
    rows = [(1, "a\nb\nc"), (2, None), (3, ""), (4, "has <S> inside\n"), (5, long), (None, "x\ny\n"), (1, "a\nb\nc"), (-3, "é\n漢\n🙂")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, form string, n int")
    got = sorted(map(tuple, fill_digest(df).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        n, form, p, m, out = plain_cut(t or "", "" if i is None else i)
        want.append((i, n, form, p, m, sha(out), sha(t or "")))
    assert got == sorted(want, key=str)
    assert fill_digest(spark.createDataFrame([], df.schema)).count() == 0
    made = fill_in_middle(df, rate=0).collect()
    assert all(r.made.form == "plain" and r.row.form == "q" for r in made)
    assert fill_middle.restore(None, "plain") == b""
