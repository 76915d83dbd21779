"""SimHash near-duplicates: exact Hamming links through vantage-point trees.

Distinct fingerprints are dealt to shards by a vantage-point tree over the
whole Hamming space; a fingerprint also visits every other shard that its ball
of the linking radius may reach (triangle bound). Within a shard a local tree
finds the pairs, which a union-find turns into a forest at once, so that no
task emits all pairs of a group. Shard forests meet in connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize
from .words import split_words

#: Fingerprints from which vantage points are chosen: the least, for each shard, and the most (8 MB); those that one
#: choice looks at.
PIVOT_SAMPLE, PIVOTS_A_SHARD, MOST_PIVOTS, CHOICE = 4096, 64, 1 << 20, 1 << 14
#: Distinct fingerprints a shard is meant to hold, and the least number of tree levels.
SHARD_POINTS, LEAST_LEVELS = 1 << 17, 4
#: Points of a leaf of the local trees.
LEAF = 64
#: Distances that one comparison step holds.
STEP = 1 << 22


def shingle_hashes(text: bytes | None, width: int, seed: int) -> list[int]:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    words = split_words(text)
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)), strict=False)]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One fingerprint a run of hashes: bits set in over half of them. Runs are not empty."""
    out = np.zeros(len(starts), np.uint64)
    sizes = np.diff(np.append(starts, len(hashes)))
    for byte in range(8):
        bits = np.unpackbits((hashes >> np.uint64(8 * byte)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        most = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[:, None]
        out |= np.packbits(most, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def text_fingerprints(texts, width: int, seed: int) -> np.ndarray:
    """SimHash of each text; 0 for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    starts: list[int] = []
    rows: list[int] = []

    def settle() -> None:
        if rows:
            out[rows] = majority(np.array(held, np.uint64), np.array(starts))
        held.clear(), starts.clear(), rows.clear()

    for i, text in enumerate(texts):
        found = shingle_hashes(text, width, seed)
        if found:
            rows.append(i)
            starts.append(len(held))
            held += found
        if len(held) > 500_000:
            settle()
    settle()
    return out


def fingerprint(text: F.Column, width: int = 3, seed: int = 42) -> F.Column:
    """SimHash of a text column as a long; 0 where it has no word or is null."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(text_fingerprints(texts, width, seed).view(np.int64))

    return run(text.cast("binary"))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose_split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """Vantage point and distance that cut the points evenly enough with the least overlap."""
    best = None
    for vp in rng.choice(points, min(24, len(points)), replace=False):
        share = np.bincount(hamming(points, vp), minlength=65) / len(points)
        below = np.cumsum(share)
        for mu in np.flatnonzero((below >= 0.2) & (below <= 0.8)):
            overlap = share[max(0, mu - radius + 1) : mu + radius + 1].sum()
            score = overlap + abs(below[mu] - 0.5)
            if best is None or score < best[0]:
                best = score, int(vp), int(mu)
    return best and best[1:]


def plan_tree(points: np.ndarray, levels: int, radius: int) -> list[tuple[int, int, int]]:
    """Inner nodes (heap index, vantage point, distance) of the tree over all shards."""
    rng, nodes, todo = np.random.default_rng(7), [], [(0, points, 0)]
    while todo:
        at, own, level = todo.pop()
        split = choose_split(rng.choice(own, CHOICE) if len(own) > CHOICE else own, radius, rng) if level < levels and len(own) > 1 else None
        if split:
            vp, mu = split
            near = hamming(own, np.uint64(vp)) <= mu
            nodes.append((at, vp, mu))
            todo += [(2 * at + 1, own[near], level + 1), (2 * at + 2, own[~near], level + 1)]
    return nodes


def route(points: np.ndarray, tree: dict[int, tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, whether it lives there) of each point and shard that it lives in or must visit."""
    out, todo = [], [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, own, home = todo.pop()
        if not len(own):
            continue
        if at not in tree:
            out.append((own, np.full(len(own), at), home))
            continue
        vp, mu = tree[at]
        d = hamming(points[own], np.uint64(vp)).astype(np.int64)
        left, right = d <= mu + radius, d > mu - radius
        todo += [(2 * at + 1, own[left], home[left] & (d[left] <= mu)), (2 * at + 2, own[right], home[right] & (d[right] > mu))]
    if not out:
        return np.array([], int), np.array([], int), np.array([], bool)
    index, shard, home = (np.concatenate(x) for x in zip(*out, strict=True))
    lives = np.empty(len(points), int)
    lives[index[home]] = shard[home]
    keep = home | (shard > lives[index])  # a pair meets in the larger shard of its two
    return index[keep], shard[keep], home[keep]


class Forest:
    """Union-find over array positions; the smaller position is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            above = self.parent[root]
            if np.array_equal(above, root):
                return root
            root = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            low, high = np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])
            if not len(low):
                return
            order = np.lexsort((low, high))
            low, high = low[order], high[order]
            first = np.append(True, high[1:] != high[:-1])
            self.parent[high[first]] = low[first]
            a, b = low[~first], high[~first]

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def near_pairs(points: np.ndarray, own: np.ndarray, asks: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (ask, own) of all points at radius or less, in steps.

    A vantage-point tree is built and walked at once: a node halves its points
    by the distance to a vantage point and passes on the queries that may reach
    either half.
    """
    rng, todo = np.random.default_rng(11), [(own, asks)]
    while todo:
        own, asks = todo.pop()
        if not len(own) or not len(asks):
            continue
        split = choose_split(rng.choice(points[own], 256) if len(own) > 256 else points[own], radius, rng) if len(own) > LEAF else None
        if split:
            vp, mu = split
            d_own, d_asks = hamming(points[own], np.uint64(vp)).astype(np.int64), hamming(points[asks], np.uint64(vp)).astype(np.int64)
            near = d_own <= mu
            if near.any() and not near.all():
                todo += [(own[near], asks[d_asks <= mu + radius]), (own[~near], asks[d_asks > mu - radius])]
                continue
        size = max(1, STEP // len(own))
        for i in range(0, len(asks), size):
            part = asks[i : i + size]
            q, p = np.nonzero(hamming(points[part][:, None], points[own][None, :]) <= radius)
            yield part[q], own[p]


def link_within(points: np.ndarray, n_home: int, radius: int) -> np.ndarray:
    """Root position of each point, where points at radius or less of the first n_home are linked."""
    forest = Forest(len(points))
    for a, b in near_pairs(points, np.arange(n_home), np.arange(len(points)), radius):
        forest.link(a, b)
    return forest.roots()


def linked_fingerprints(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, label) of every fingerprint that has another within radius; equal labels: connected."""
    n = distinct.count()
    levels = max(LEAST_LEVELS, int(np.ceil(np.log2(max(1, n / SHARD_POINTS)))))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b["fp"].to_numpy() for b in batches]
        points = np.concatenate(parts).view(np.uint64) if parts else np.array([], np.uint64)
        nodes = plan_tree(points, levels, radius)
        yield pd.DataFrame([(a, np.uint64(v).astype(np.int64), m) for a, v, m in nodes], columns=["at", "vp", "mu"])

    pivots = min(MOST_PIVOTS, max(PIVOT_SAMPLE, PIVOTS_A_SHARD << levels))
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(pivots).coalesce(1)
    # MOST_PIVOTS nodes at most.
    tree = {r.at: (r.vp & (2**64 - 1), r.mu) for r in sample.mapInPandas(plan, "at long, vp long, mu int").collect()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            index, shard, home = route(fp.view(np.uint64), tree, radius)
            yield pd.DataFrame({"fp": fp[index], "shard": shard, "home": home})

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["home", "fp"], ascending=[False, True])
        fp = rows["fp"].to_numpy().copy()
        roots = link_within(fp.view(np.uint64), int(rows["home"].sum()), radius)
        more = np.bincount(roots, minlength=len(fp))[roots] > 1
        return pd.DataFrame({"fp": fp[more], "root": fp[roots[more]]})

    members = materialize(
        distinct.select("fp").mapInPandas(deal, "fp long, shard long, home boolean").groupBy("shard").applyInPandas(link, "fp long, root long"),
        "members",
    )
    return merge_forests(members, "fp")


def merge_forests(members: DataFrame, key: str) -> DataFrame:
    """(key, label) from (key, root) rows of many forests that share keys; equal labels: connected."""
    one = members.groupBy(key).agg(F.min("root").alias("root"), F.max("root").alias("last"))
    apart = one.filter("root < last").select(key, F.col("root").alias("v"))
    edges = members.join(apart, key).select(F.col("root").alias("u"), "v").filter("u <> v").distinct()
    merged = connected_components(edges).select(F.col("node").alias("root"), "component")
    return one.join(merged, "root", "left").select(key, F.coalesce("component", "root").alias("label"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, seed: int = 42
) -> DataFrame:
    """(doc_id, fp long, component_id): fingerprints linked at radius or fewer differing bits.

    component_id is the smallest id that links reach, the document itself
    included. A text that is null or has no word has fingerprint 0 and is
    linked like any other. Each input row gives one row, repeated rows too; a
    null id takes part in linking and gets the smallest other id (null if none).
    An empty table gives no rows; whole texts count, however long; columns
    beside id and text are not read, whatever their names.
    """
    prints = materialize(docs.select(F.col(id_col).alias("row"), fingerprint(F.col(text_col), width, seed).alias("fp")), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("row").alias("least")), "distinct")
    linked = linked_fingerprints(distinct, radius)
    labelled = materialize(distinct.join(linked, "fp").select("fp", "least", "label"), "labelled")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    joined = labelled.join(least, "label").select("fp", "component_id")
    ids = distinct.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(ids, "fp").select(F.col("row").alias("doc_id"), "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query: fingerprint as 16 lower-case hex digits."""
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
