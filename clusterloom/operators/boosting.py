"""Gradient boosting on histograms: quantile bins with one for missing values, trees grown leaf by leaf.

Rows are packed into blocks of bin numbers once. A pass sums gradients by
(leaf, feature, bin) in the tasks and adds these up; the leaves that the pass
makes ready are split ahead of their turn, so that a tree takes as many passes
as it is deep although its leaves are split in the order of their gains. Tables
of up to LOCAL_CELLS cells are fitted in one task by the same code.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a block, cells (rows x features) that one task fits, trees between two writings of the predictions, and
#: partial sums that are added at once.
BLOCK_ROWS, LOCAL_CELLS, REWRITE, FAN = 1 << 14, 50_000_000, 16, 16


@dataclass(frozen=True)
class Settings:
    """Fixed values of the protocol's reranker (RNK-09)."""

    rate: float = 0.08
    iterations: int = 150
    leaves: int = 31
    least_rows: int = 20
    l2: float = 1.0
    bins: int = 255


@dataclass
class Tree:
    """Nodes by number: feature (-1: a leaf), last bin of the left side, whether missing goes left, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    children: list[tuple[int, int]] = field(default_factory=lambda: [(-1, -1)])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, last: int, missing_left: bool) -> tuple[int, int]:
        both = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.missing_left[node], self.children[node] = feature, last, missing_left, both
        for _ in both:
            self.feature.append(-1), self.bin.append(0), self.missing_left.append(False), self.children.append((-1, -1)), self.value.append(0.0)
        return both

    def leaf_of(self, x: np.ndarray, missing: int) -> np.ndarray:
        """Leaf number of each row of bins."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if self.feature[node] < 0:
                out[own] = node
                continue
            b = x[own, self.feature[node]]
            left = np.where(b == missing, self.missing_left[node], b <= self.bin[node])
            todo += [(self.children[node][0], own[left]), (self.children[node][1], own[~left])]
        return out

    def predict(self, x: np.ndarray, missing: int) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x, missing)]

    def kept(self, wanted: set[int]) -> Tree:
        """The tree with the splits of the wanted nodes only, numbered anew."""
        out, todo = Tree(value=[self.value[0]]), [(0, 0)]
        while todo:
            old, new = todo.pop()
            if old in wanted:
                for a, b in zip(self.children[old], out.split(new, self.feature[old], self.bin[old], self.missing_left[old]), strict=True):
                    out.value[b] = self.value[a]
                    todo.append((a, b))
        return out


@dataclass
class Boosted:
    """Bin edges of each feature, the first prediction, and trees whose values carry the rate."""

    columns: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]
    missing: int

    def predict(self, values: np.ndarray) -> np.ndarray:
        x = binned(values, self.edges, self.missing)
        return self.start + sum((t.predict(x, self.missing) for t in self.trees), np.zeros(len(x)))

    def transform(self, rows: DataFrame, name: str = "predicted") -> DataFrame:
        """rows with the prediction; NULL and NaN are missing values."""
        model = self

        @F.pandas_udf("double")
        def run(values: pd.DataFrame) -> pd.Series:
            return pd.Series(model.predict(values.to_numpy(float)))

        return rows.withColumn(name, run(F.struct(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(self.columns)))))


def binned(values: np.ndarray, edges: Sequence[np.ndarray], missing: int) -> np.ndarray:
    """Bin of each cell: the number of edges below it; missing for NaN."""
    out = np.empty(values.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(values[:, f]), missing, np.searchsorted(e, values[:, f], "left"))
    return out


def histograms(x: np.ndarray, gradient: np.ndarray, leaf: np.ndarray, wanted: Sequence[int], missing: int) -> dict[int, np.ndarray]:
    """(features, bins, 2) of each wanted leaf: sums of gradients and of rows."""
    out, n = {}, missing + 1
    for node in wanted:
        own = leaf == node
        xs, g = x[own], gradient[own]
        flat = (xs.astype(np.int64) + np.arange(x.shape[1]) * n).ravel()
        sums = np.bincount(flat, np.repeat(g, x.shape[1]), x.shape[1] * n), np.bincount(flat, minlength=x.shape[1] * n)
        out[node] = np.stack(sums, -1).reshape(x.shape[1], n, 2).astype(float)
    return out


def best_split(h: np.ndarray, s: Settings) -> tuple[float, int, int, bool] | None:
    """(gain, feature, last left bin, missing left) of the best split of a leaf's histogram; None without one.

    Missing rows are tried on both sides; without any they go with the larger.
    """
    total, missing = h[0].sum(0), h[:, -1]
    score = lambda g, n: g * g / np.maximum(n + s.l2, 1e-300)
    left = np.cumsum(h[:, :-1], axis=1)  # all known rows on one side is a split from the missing ones
    best = None
    for with_missing in (False, True):
        a = left + missing[:, None, :] if with_missing else left
        b = total - a
        gain = score(a[..., 0], a[..., 1]) + score(b[..., 0], b[..., 1]) - score(*total)
        gain[(a[..., 1] < s.least_rows) | (b[..., 1] < s.least_rows)] = -np.inf
        if with_missing:
            gain[missing[:, 1] == 0] = -np.inf
        f, k = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, k] > 1e-12 and (best is None or gain[f, k] > best[0]):
            larger = bool(a[f, k, 1] >= b[f, k, 1]) if missing[f, 1] == 0 else with_missing
            best = float(gain[f, k]), int(f), int(k), larger
    return best


def grow(sums: Callable[[Tree, list[int]], dict[int, np.ndarray]], s: Settings) -> Tree:
    """A tree of s.leaves leaves at most: the leaf with the largest gain is split next, ties to the older.

    sums gives the histograms of some leaves. Ready leaves are split ahead of
    their turn; of these splits only those whose turn came stay.
    """
    ahead, found, ready = Tree(), {}, [0]
    while True:
        for node, h in sums(ahead, ready).items():
            g, n = h[0].sum(0)
            ahead.value[node] = -s.rate * g / (n + s.l2) if n else 0.0
            found[node] = best_split(h, s) if n >= 2 * s.least_rows else None
        # The splits in order of their gains, as far as their leaves are known.
        turn, chosen, unknown = [(-found[0][0], 0)] if found[0] else [], [], False
        while turn and len(chosen) < s.leaves - 1:
            node = heapq.heappop(turn)[1]
            chosen.append(node)
            if ahead.feature[node] < 0:
                unknown = True  # its children have no histogram yet
                continue
            for child in ahead.children[node]:
                if found.get(child):
                    heapq.heappush(turn, (-found[child][0], child))
        if not unknown:
            return ahead.kept(set(chosen))
        ready = []
        for node in chosen:
            if ahead.feature[node] < 0:
                ready += ahead.split(node, *found[node][1:])


def fit_blocks(x: np.ndarray, y: np.ndarray, missing: int, s: Settings) -> tuple[float, list[Tree]]:
    """All trees for rows of bins in memory."""
    start = float(y.mean()) if len(y) else 0.0
    predicted, trees = np.full(len(y), start), []
    for _ in range(s.iterations):
        tree = grow(lambda t, wanted: histograms(x, predicted - y, t.leaf_of(x, missing), wanted, missing), s)  # noqa: B023
        trees.append(tree)
        predicted = predicted + tree.predict(x, missing)
    return start, trees


def quantile_edges(rows: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each feature: approximate quantiles, each once; one aggregation."""
    share = [i / bins for i in range(1, bins)]
    cell = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = rows.agg(*(F.percentile_approx(cell(c), share, 10_000).alias(f"q{i}") for i, c in enumerate(columns))).first()
    return [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(len(columns))]


def fit(train: DataFrame, columns: Sequence[str], target: str, settings: Settings = Settings()) -> Boosted:  # noqa: B008
    """Boosted trees of the squared error (RNK-09). Rows without a target are left out; infinities count as missing."""
    s, missing, names = settings, settings.bins, list(columns)
    own = train.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    clean = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    values = own.select(*(clean(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(target).cast("double").alias("y"))
    cells = [f"c{i}" for i in range(len(names))]
    edges = quantile_edges(values, cells, s.bins)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), BLOCK_ROWS):
                part = b.iloc[a : a + BLOCK_ROWS]
                yield pd.DataFrame({"n": [len(part)], "x": [binned(part[cells].to_numpy(float), edges, missing).tobytes()], "y": [part["y"].to_numpy("<f8").tobytes()]})

    blocks = written(values.mapInPandas(pack, "n long, x binary, y binary"), "bins")
    n = blocks.agg(F.sum("n")).first()[0] or 0
    if n * max(1, len(names)) <= LOCAL_CELLS:
        start, trees = _fit_in_task(blocks, len(names), missing, s)
    else:
        start, trees = _fit_in_passes(blocks, len(names), missing, s)
    return Boosted(names, edges, start, trees, missing)


def _arrays(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.x, np.uint8).reshape(-1, width), np.frombuffer(row.y, "<f8")


def _fit_in_task(blocks: DataFrame, width: int, missing: int, s: Settings) -> tuple[float, list[Tree]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [_arrays(r, width) for b in batches for r in b.itertuples()]
        x = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, width), np.uint8)
        y = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
        yield pd.DataFrame({"model": [pickle.dumps(fit_blocks(x, y, missing, s))]})

    return pickle.loads(blocks.coalesce(1).mapInPandas(run, "model binary").first().model)


def _fit_in_passes(blocks: DataFrame, width: int, missing: int, s: Settings) -> tuple[float, list[Tree]]:
    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": [float(np.frombuffer(y, "<f8").sum()) for y in b["y"]], "n": b["n"]})

    facts = blocks.mapInPandas(totals, "s double, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    start = facts.s / facts.n

    def led(batches: Iterator[pd.DataFrame], fresh: list[Tree], first: bool) -> Iterator[pd.DataFrame]:
        """Blocks with their predictions after the fresh trees."""
        for b in batches:
            p = []
            for r in b.itertuples():
                x, y = _arrays(r, width)
                before = np.full(len(y), start) if first else np.frombuffer(r.p, "<f8")
                p.append(sum((t.predict(x, missing) for t in fresh), before).astype("<f8").tobytes())
            yield b[["n", "x", "y"]].assign(p=p)

    ddl, trees, fresh = "n long, x binary, y binary, p binary", [], []
    state = written(blocks.mapInPandas(lambda b: led(b, [], True), ddl), "predictions")
    for _ in range(s.iterations):
        if len(fresh) >= REWRITE:
            past = list(fresh)
            state, fresh = written(state.mapInPandas(lambda b, past=past: led(b, past, False), ddl), "predictions"), []
        now = list(fresh)

        def sums(tree: Tree, wanted: list[int], state=state, now=now) -> dict[int, np.ndarray]:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                from pyspark import TaskContext

                total: dict[int, np.ndarray] = {}
                for b in batches:
                    for r in b.itertuples():
                        x, y = _arrays(r, width)
                        predicted = sum((t.predict(x, missing) for t in now), np.frombuffer(r.p, "<f8"))
                        for node, h in histograms(x, predicted - y, tree.leaf_of(x, missing), wanted, missing).items():
                            total[node] = total.get(node, 0) + h
                part = TaskContext.get().partitionId()
                yield pd.DataFrame({"node": list(total), "part": part, "h": [h.tobytes() for h in total.values()]}).astype({"node": "int64"})

            def add(rows: pd.DataFrame) -> pd.DataFrame:
                rows = rows.sort_values("part")
                h = np.sum([np.frombuffer(v, "<f8") for v in rows["h"]], axis=0)
                return pd.DataFrame({"node": rows["node"].iloc[:1], "part": rows["part"].iloc[:1], "h": [h.tobytes()]})

            kinds = "node long, part long, h binary"
            some = state.mapInPandas(run, kinds).withColumn("fan", F.pmod("part", F.lit(FAN))).groupBy("node", "fan").applyInPandas(lambda rows: add(rows), kinds)
            # As many rows as wanted leaves, each of features x bins sums.
            found = some.groupBy("node").applyInPandas(add, kinds).collect()
            return {r.node: np.frombuffer(r.h, "<f8").reshape(width, missing + 1, 2) for r in found}

        tree = grow(sums, s)
        trees.append(tree)
        fresh.append(tree)
    return start, trees
