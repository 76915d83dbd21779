"""Pairwise work on clouds that no task can hold: blocks of points meet blocks of points, in many tasks.

A cloud is cut into blocks that are compact in the plane (strips by x, cut by
y), each packed into one row. Block pairs are dealt to tasks; a task folds its
distances into a few numbers a point or a cluster, so distances are never
rows. Work that asks for the nearest only visits blocks whose boxes may hold
something nearer than what is known. A sum over all pairs stays quadratic:
points of a cloud are copied once for each BLOCK of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Points of a block, blocks that one block meets in a task, and distances that a step holds.
BLOCK, CHUNK, STEP = 4096, 16, 1 << 21
PACKED = "block long, n long, x0 double, x1 double, y0 double, y1 double, ids binary, xy binary, labels binary, extra binary"


class Block:
    """Points of a packed row: ids, coordinates, labels, and extra columns of doubles."""

    def __init__(self, row):
        self.ids, self.labels = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8")
        self.xy = np.frombuffer(row.xy, "<f8").reshape(-1, 2)
        self.extra = np.frombuffer(row.extra, "<f8").reshape(len(self.ids), -1)

    def steps(self, other: Block):
        """(slice of own points, their distances to all points of other)."""
        size = max(1, STEP // max(1, len(other.ids)))
        for i in range(0, len(self.ids), size):
            own = self.xy[i : i + size]
            yield slice(i, i + size), np.sqrt((own[:, None, 0] - other.xy[None, :, 0]) ** 2 + (own[:, None, 1] - other.xy[None, :, 1]) ** 2)


def _named(points: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{k} {points.schema[k].dataType.simpleString()}, " for k in keys)


def _on(a: DataFrame, b: DataFrame, names: Sequence[str]) -> DataFrame:
    return a.join(b, list(names)) if names else a.crossJoin(b)  # b has one row where there is no key


def blocks_of(points: DataFrame, keys: Sequence[str], extra: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """Packed blocks (keys, PACKED) of points (keys, point_id, x, y, label, extra); about size points each, written."""
    return packed(laid_out(points, keys, extra, size), keys, extra)


def packed(placed: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Packed blocks, written, of points that have their _block."""
    names, more = list(keys), list(extra)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        facts = {**{k: rows[k].iloc[0] for k in names}, "block": int(rows["_block"].iloc[0]), "n": len(rows), "x0": x.min(), "x1": x.max(), "y0": y.min(), "y1": y.max()}
        data = {"ids": rows["point_id"].to_numpy("<i8"), "xy": np.column_stack((x, y)).astype("<f8"), "labels": rows["label"].to_numpy("<i8"), "extra": rows[more].to_numpy("<f8")}
        return pd.DataFrame({k: [v] for k, v in (facts | {k: v.tobytes() for k, v in data.items()}).items()})

    own = placed.select(*names, "_block", "point_id", "x", "y", "label", *(F.col(c).cast("double").alias(c) for c in more))
    return written(own.groupBy(*names, "_block").applyInPandas(pack, _named(placed, names) + PACKED), "blocks")


def laid_out(points: DataFrame, keys: Sequence[str], extra: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """points (keys, point_id, x, y, label, extra) with the number of their _block."""
    names = list(keys)
    own = points.select(*names, F.col("point_id").cast("long").alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("label").cast("long").alias("label"), *extra)
    sizes = own.groupBy(*names).agg(F.count("*").alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1")).withColumn("_parts", F.ceil(F.sqrt(F.col("_n") / size)))
    # Strips by histogram: equal widths would crowd; the quantiles of a fixed grid of 1,024 bins are near enough.
    bins = lambda c, low, high: F.least(F.lit(1023), F.floor((F.col(c) - F.col(low)) / F.greatest(F.col(high) - F.col(low), F.lit(1e-300)) * 1024)).cast("int")
    binned = _on(own, sizes, names).withColumn("_bin", bins("x", "_x0", "_x1"))
    strips = _dealt(binned, [*names], "_parts", "_strip")
    tall = strips.groupBy(*names, "_strip").agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    placed = _dealt(strips.join(tall, [*names, "_strip"]).withColumn("_bin", bins("y", "_y0", "_y1")), [*names, "_strip"], "_parts", "_row")
    crowd = placed.groupBy(*names, "_strip", "_row").agg(F.ceil(F.count("*") / (2 * size)).alias("_split"))
    block = (F.col("_strip") * F.col("_parts") + F.col("_row")) * (1 << 20) + F.pmod(F.xxhash64("point_id"), F.col("_split"))
    return placed.join(crowd, [*names, "_strip", "_row"]).select(*names, block.alias("_block"), "point_id", "x", "y", "label", *extra)


def _dealt(rows: DataFrame, by: Sequence[str], parts: str, name: str) -> DataFrame:
    """rows with the number of the equal share, of parts, that their bin (1,024 a group at most) begins in."""
    count = rows.groupBy(*by, "_bin").agg(F.count("*").alias("_c"), F.max(parts).alias("_p"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin")) - F.col("_c")
    share = count.withColumn(name, F.floor(before * F.col("_p") / F.sum("_c").over(Window.partitionBy(*by)))).select(*by, "_bin", name)
    return rows.join(share, [*by, "_bin"]).drop("_bin")


def _gap() -> Column:
    """Least distance that points of the boxes of blocks i (x0, ...) and j (bx0, ...) can have."""
    far = lambda a, b, c, d: F.greatest(F.lit(0.0), F.col(c) - F.col(b), F.col(a) - F.col(d))
    dx, dy = far("x0", "x1", "bx0", "bx1"), far("y0", "y1", "by0", "by1")
    return F.sqrt(dx * dx + dy * dy)


def block_pairs(blocks: DataFrame, keys: Sequence[str], half: bool = False) -> DataFrame:
    """(keys, i, j, gap) of the block pairs of each cloud: boxes only; half: each pair once, a block with itself too."""
    box = ["x0", "x1", "y0", "y1"]
    a = blocks.select(*keys, F.col("block").alias("i"), *box)
    b = blocks.select(*keys, F.col("block").alias("j"), *(F.col(c).alias(f"b{c}") for c in box))
    both = _on(a, b, keys)
    return (both.filter("i <= j") if half else both).select(*keys, "i", "j", _gap().alias("gap"))


def visit(blocks: DataFrame, pairs: DataFrame, keys: Sequence[str], run: Callable, ddl: str, facts: DataFrame | None = None) -> DataFrame:
    """Rows (keys, ddl) that run(block i, blocks j, facts of block i) gives for the pairs, CHUNK of them a task."""
    names = list(keys)
    dealt = written(pairs.select(*names, "i", "j", F.xxhash64("j").alias("_h")), "pairs")
    counts = dealt.groupBy(*names, "i").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    dealt = dealt.join(counts, [*names, "i"]).withColumn("chunk", F.pmod(F.col("_h"), F.col("_chunks"))).select(*names, "i", "j", "chunk")
    asking = dealt.select(*names, "i", "chunk").distinct().join(blocks.withColumnRenamed("block", "i"), [*names, "i"])
    if facts is not None:
        asking = asking.join(facts, [*names, "i"], "left")
    given = dealt.join(blocks.withColumnRenamed("block", "j"), [*names, "j"])
    by = [*names, "i", "chunk"]

    def task(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in ddl.split(", ")]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*names, *columns])
        row = next(left.itertuples())
        out = run(Block(row), [Block(r) for r in right.sort_values("j").itertuples()], row)
        return out.assign(**dict(zip(names, key, strict=False)))[[*names, *columns]]

    asking = asking.select(*(F.col(c).alias(c) for c in asking.columns))  # both sides come from one table
    return asking.groupBy(*by).cogroup(given.groupBy(*by)).applyInPandas(task, _named(blocks, names) + ddl)


# --- the indices -----------------------------------------------------------------------------------


def silhouette(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, raw): mean silhouette of whole clouds (CVI-01); singletons count 0, a single cluster gives NULL."""
    names, blocks = list(keys), blocks_of(points, keys)
    sizes = points.groupBy(*names, F.col("label").cast("long").alias("label")).agg(F.count("*").alias("size"))

    def fold(own: Block, others: list[Block], row) -> pd.DataFrame:
        clusters = np.unique(np.concatenate([o.labels for o in others]))
        sums = np.zeros((len(own.ids), len(clusters)))
        for o in others:
            one = (o.labels[:, None] == clusters[None, :]).astype(float)
            for at, d in own.steps(o):
                sums[at] += d @ one
        i, c = np.indices(sums.shape)
        return pd.DataFrame({"point_id": own.ids[i.ravel()], "label": own.labels[i.ravel()], "other": clusters[c.ravel()], "total": sums.ravel()})

    partial = visit(blocks, block_pairs(blocks, names), names, fold, "point_id long, label long, other long, total double")
    sums = partial.groupBy(*names, "point_id", "label", "other").agg(F.sum("total").alias("total"))
    sized = sums.join(sizes.withColumnRenamed("label", "other"), [*names, "other"])
    mine = F.col("label") == F.col("other")
    a = F.max(F.when(mine, F.when(F.col("size") > 1, F.col("total") / (F.col("size") - 1))))
    b = F.min(F.when(~mine, F.col("total") / F.col("size")))
    each = sized.groupBy(*names, "point_id").agg(a.alias("a"), b.alias("b"))
    value = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300)))
    return each.groupBy(*names).agg(F.when(F.count("b") > 0, F.avg(value)).alias("raw"))


def extremes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, least, most): least distance between clusters and largest within one (CVI-12, BL-01).

    Farthest pairs need all block pairs; the same pass finds the nearest.
    """
    names, blocks = list(keys), blocks_of(points, keys)

    def fold(own: Block, others: list[Block], row) -> pd.DataFrame:
        least, most = np.inf, 0.0
        for o in others:
            for at, d in own.steps(o):
                same = own.labels[at, None] == o.labels[None, :]
                least = min(least, float(np.where(same, np.inf, d).min()))
                most = max(most, float(np.where(same, d, 0.0).max()))
        return pd.DataFrame({"least": [least], "most": [most]})

    found = visit(blocks, block_pairs(blocks, names, half=True), names, fold, "least double, most double")
    return found.groupBy(*names).agg(F.min("least").alias("least"), F.max("most").alias("most"))


def min_intercluster_distance(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CVI-12."""
    return extremes(points, keys).select(*keys, F.when(F.col("least") < float("inf"), F.col("least")).alias("raw"))


def dunn(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """BL-01: least distance between clusters over the largest diameter."""
    ok = (F.col("least") < float("inf")) & (F.col("most") > 0)
    return extremes(points, keys).select(*keys, F.when(ok, F.col("least") / F.col("most")).alias("raw"))


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least distances of each row, equal ones by id; ids are ascending."""
    if d.shape[1] <= k:
        return np.argsort(d, 1, kind="stable")
    kth = np.partition(d, k - 1, 1)[:, k - 1 : k]
    near = np.argpartition(d, k - 1, 1)[:, :k]
    out = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d, near, 1)), axis=1), 1)
    for i in np.flatnonzero((d <= kth).sum(1) > k):  # more ties at the kth than places
        out[i] = np.lexsort((ids, d[i]))[:k]
    return out


def neighbours(blocks: DataFrame, keys: Sequence[str], k: int, same_label: bool = False) -> DataFrame:
    """(keys, point_id, label, other, other_label, d) of the k nearest points of each point; equal distances by id.

    A point's block gives it a kth distance at most; other blocks are visited
    where their box is within that of one of the block's points.
    """
    names = list(keys)
    ddl = "point_id long, label long, other long, other_label long, d double, block long"

    def fold(own: Block, others: list[Block], row) -> pd.DataFrame:
        ids, labels, xy = (np.concatenate([getattr(o, c) for o in others]) for c in ("ids", "labels", "xy"))
        order = np.argsort(ids, kind="stable")
        ids, labels, xy, parts = ids[order], labels[order], xy[order], []
        size = max(1, STEP // max(1, len(ids)))
        for i in range(0, len(own.ids), size):
            at = slice(i, i + size)
            d = np.sqrt((own.xy[at, None, 0] - xy[None, :, 0]) ** 2 + (own.xy[at, None, 1] - xy[None, :, 1]) ** 2)
            d[own.ids[at, None] == ids[None, :]] = np.inf
            if same_label:
                d[own.labels[at, None] != labels[None, :]] = np.inf
            near = _nearest(d, ids, k)
            r, c = np.repeat(np.arange(len(d)), near.shape[1]), near.ravel()
            ok = np.isfinite(d[r, c])
            r, c = r[ok], c[ok]
            parts.append(pd.DataFrame({"point_id": own.ids[at][r], "label": own.labels[at][r], "other": ids[c], "other_label": labels[c], "d": d[r, c], "block": row.i}))
        return pd.concat(parts)

    pairs = block_pairs(blocks, names)
    home = written(visit(blocks, pairs.filter("i = j"), names, fold, ddl), "near")
    reach = home.groupBy(*names, "block", "point_id").agg(F.count("*").alias("_c"), F.max("d").alias("_d"))
    bound = reach.groupBy(*names, F.col("block").alias("i")).agg(F.max(F.when(F.col("_c") >= k, F.col("_d")).otherwise(float("inf"))).alias("bound"), F.count("*").alias("_m"))
    whole = blocks.select(*names, F.col("block").alias("i"), "n")
    # A block with a point that has no neighbour at home has no bound.
    limits = whole.join(bound, [*names, "i"], "left").select(*names, "i", F.when(F.col("_m") == F.col("n"), F.col("bound")).otherwise(float("inf")).alias("bound"))
    more = pairs.filter("i <> j").join(limits, [*names, "i"]).filter("gap <= bound")
    found = home.union(visit(blocks, more, names, fold, ddl).select(home.columns))
    order = Window.partitionBy(*names, "point_id").orderBy("d", "other")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select(*names, "point_id", "label", "other", "other_label", "d", F.col("_r").alias("rank"))


def neighborhood_purity(points: DataFrame, keys: Sequence[str], ks: Sequence[int] = (10,)) -> DataFrame:
    """CVI-10 and CVI-11: share of the nearest neighbours with the point's label, mean over the sizes."""
    names = list(keys)
    near = written(neighbours(blocks_of(points, keys), names, max(ks)), "near")
    n = points.groupBy(*names).agg(F.count("*").alias("n"))
    same = (F.col("label") == F.col("other_label")).cast("double")
    shares = near.groupBy(*names).agg(*(F.sum(F.when(F.col("rank") <= k, same)).alias(f"s{k}") for k in ks))
    value = sum(F.col(f"s{k}") / F.least(F.lit(k), F.col("n") - 1) / F.col("n") for k in ks) / len(ks)
    return _on(shares, n, names).select(*names, value.alias("raw"))


# --- spanning trees --------------------------------------------------------------------------------


def reachability(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest of the distances and both core values."""
    return np.maximum(d, np.maximum(a, b))


def stretched(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances made longer by both factors, by themselves at most twice."""
    return d + np.sqrt(a * b) * d


def spanning_edges(points: DataFrame, keys: Sequence[str], size: int = BLOCK, weigh: Callable = reachability) -> DataFrame:
    """(keys, label, u, v, w) of the least spanning tree of each cluster of points (keys, point_id, x, y, label, core), written.

    The weight of two points is weigh(distance, core, core), the distance or
    more. Boruvka's rounds: each part of a tree takes its lightest edge to
    another part of its cluster (ties by ids), which at least halves the parts.
    A round looks into a point's own block first; other blocks are visited only
    where their box is nearer than the lightest edge that a part of the block
    has so far.
    """
    names = list(keys)
    ddl = "comp long, w double, u long, v long, label long, to long"
    order = lambda *c: F.min(F.struct(*c))
    placed = laid_out(points.select(*names, "point_id", "x", "y", "label", "core"), names, ("core",), size)
    state, tree, pairs = written(placed.withColumn("comp", F.col("point_id")), "parts"), None, None
    while True:
        # Ids travel as doubles in the packed rows: they are numbers of rows, below 2^53.
        blocks = packed(state, names, ("core", "comp"))
        pairs = written(block_pairs(blocks, names), "gaps") if pairs is None else pairs

        def lightest(own: Block, others: list[Block], row) -> pd.DataFrame:
            best: dict[int, tuple] = {}
            comp, core = own.extra[:, 1].astype(np.int64), own.extra[:, 0]
            limit = np.frombuffer(row.limits, "<f8") if getattr(row, "limits", None) is not None else np.full(len(comp), np.inf)
            for o in others:
                there = o.extra[:, 1].astype(np.int64)
                for at, d in own.steps(o):
                    w = weigh(d, core[at, None], o.extra[None, :, 0])
                    w[(own.labels[at, None] != o.labels[None, :]) | (comp[at, None] == there[None, :])] = np.inf
                    least = w.min(1)
                    for i in np.flatnonzero((least <= limit[at]) & np.isfinite(least)):
                        c, me = int(comp[at][i]), int(own.ids[at][i])
                        for j in np.flatnonzero(w[i] == least[i]):
                            edge = (float(least[i]), min(me, int(o.ids[j])), max(me, int(o.ids[j])), int(own.labels[at][i]), int(there[j]))
                            if c not in best or edge < best[c]:
                                best[c] = edge
            return pd.DataFrame([(c, *e) for c, e in best.items()], columns=["comp", "w", "u", "v", "label", "to"])

        home = written(visit(blocks, pairs.filter("i = j"), names, lightest, ddl), "edges")
        known = home.groupBy(*names, "comp").agg(F.min("w").alias("limit"))

        def listed(batches):
            for b in batches:
                for r in b.itertuples():
                    own = Block(r)
                    yield pd.DataFrame({**{k: [getattr(r, k)] * len(own.ids) for k in names}, "i": r.block, "at": np.arange(len(own.ids)), "comp": own.extra[:, 1].astype(np.int64)})

        def bound(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            limit = rows["limit"].fillna(np.inf).to_numpy("<f8")
            return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in names}, "i": [int(rows["i"].iloc[0])], "limits": [limit.tobytes()], "most": [float(limit.max())]})

        asked = blocks.mapInPandas(listed, _named(points, names) + "i long, at long, comp long").join(known, [*names, "comp"], "left")
        limits = written(asked.groupBy(*names, "i").applyInPandas(bound, _named(points, names) + "i long, limits binary, most double"), "limits")
        more = pairs.filter("i <> j").join(limits.select(*names, "i", "most"), [*names, "i"]).filter("gap <= most")
        found = home.union(visit(blocks, more, names, lightest, ddl, limits.drop("most")).select(home.columns))
        picked = found.groupBy(*names, "comp").agg(order("w", "u", "v", "label", "to").alias("e")).select(*names, "comp", "e.*")
        picked = written(picked, "picked")
        if not picked.limit(1).count():
            return tree if tree is not None else written(picked.select(*names, "label", "u", "v", "w"), "tree")
        new = picked.select(*names, "label", "u", "v", "w").distinct()
        tree = written(new if tree is None else tree.union(new.select(tree.columns)), "tree")
        state = written(_merged(state, picked, names), "parts")


def _merged(state: DataFrame, picked: DataFrame, names: list[str]) -> DataFrame:
    """state with the parts that picked edges (comp, to) join named alike: chosen edges form trees with one pair of mutual choices."""
    back = picked.select(*names, F.col("comp").alias("to"), F.col("to").alias("_back"))
    jump = picked.select(*names, "comp", "to").join(back, [*names, "to"])
    up = written(jump.select(*names, "comp", F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root")), "roots")
    while True:  # pointer jumping: the path to the root halves each time
        above = up.select(*names, F.col("comp").alias("root"), F.col("root").alias("_next"))
        after = written(up.join(above, [*names, "root"], "left").select(*names, "comp", "root", F.coalesce("_next", "root").alias("_next")), "roots")
        moved = after.filter("_next <> root").limit(1).count()
        up = after.select(*names, "comp", F.col("_next").alias("root"))
        if not moved:
            break
    return state.join(up, [*names, "comp"], "left").select(*[c for c in state.columns if c != "comp"], F.coalesce("root", "comp").alias("comp"))


def point_sums(points: DataFrame, keys: Sequence[str], blocks: DataFrame, fold: Callable) -> DataFrame:
    """(keys, point_id, total) over all blocks of what fold(distances, own labels, other labels) gives each point."""

    def run(own: Block, others: list[Block], row) -> pd.DataFrame:
        total = np.zeros(len(own.ids))
        for o in others:
            for at, d in own.steps(o):
                total[at] += fold(d, own.labels[at, None], o.labels[None, :])
        return pd.DataFrame({"point_id": own.ids, "total": total})

    found = visit(blocks, block_pairs(blocks, keys), keys, run, "point_id long, total double")
    return found.groupBy(*keys, "point_id").agg(F.sum("total").alias("total"))


def distances_within(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a == b, d, 0.0).sum(1)


def _inverse_squares(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return (np.where((d > 0) & (a == b), 1 / d, 0.0) ** 2).sum(1)


def _gaps(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, other, apart): least weight between points of two clusters, of points with a core value."""
    blocks = blocks_of(points, keys, ("core",))

    def run(own: Block, others: list[Block], row) -> pd.DataFrame:
        best: dict[tuple[int, int], float] = {}
        for o in others:
            for at, d in own.steps(o):
                w = np.maximum(d, np.maximum(own.extra[at], o.extra[None, :, 0]))
                for b in np.unique(o.labels):
                    least = w[:, o.labels == b].min(1)
                    for a in np.unique(own.labels[at]):
                        if a != b:
                            pair = (int(min(a, b)), int(max(a, b)))
                            best[pair] = min(best.get(pair, np.inf), float(least[own.labels[at] == a].min()))
        return pd.DataFrame([(a, b, w) for (a, b), w in best.items()], columns=["label", "other", "apart"])

    found = visit(blocks, block_pairs(blocks, keys, half=True), keys, run, "label long, other long, apart double")
    return found.groupBy(*keys, "label", "other").agg(F.min("apart").alias("apart"))


def dbcv(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, raw): CVI-04 of whole clouds: density sparseness within against density separation between clusters, by size."""
    names = list(keys)
    count = points.groupBy(*names, "label").agg(F.count("*").alias("size"))
    own = points.join(count.filter("size > 2").select(*names, "label"), [*names, "label"]).select(*names, F.col("point_id").cast("long").alias("point_id"), "x", "y", F.col("label").cast("long").alias("label"))
    sums = point_sums(own, names, blocks_of(own, names), _inverse_squares)
    sized = own.join(count.withColumn("label", F.col("label").cast("long")), [*names, "label"]).join(sums, [*names, "point_id"])
    core = F.pow(F.greatest(F.col("total") / F.greatest(F.lit(1), F.col("size") - 1), F.lit(1e-300)), F.lit(-0.5))
    cored = written(sized.select(*names, "point_id", "x", "y", "label", core.alias("core")), "cores")
    tree = spanning_edges(cored, names)
    degree = tree.select(*names, "label", F.explode(F.array("u", "v")).alias("point_id")).groupBy(*names, "label", "point_id").agg(F.count("*").alias("degree"))
    end = lambda c: degree.select(*names, F.col("point_id").alias(c), F.col("degree").alias(f"d{c}"))
    inside = (F.col("du") > 1) & (F.col("dv") > 1)
    sparse = tree.join(end("u"), [*names, "u"]).join(end("v"), [*names, "v"]).groupBy(*names, "label").agg(F.coalesce(F.max(F.when(inside, F.col("w"))), F.max("w")).alias("sparse"))
    deep = degree.groupBy(*names, "label").agg((F.max("degree") > 1).alias("_deep"))
    kept = cored.join(degree.select(*names, "point_id", "degree"), [*names, "point_id"]).join(deep, [*names, "label"]).filter("degree > 1 or not _deep")
    pairs = _gaps(kept.select(*names, "point_id", "x", "y", "label", "core"), names)
    gaps = pairs.select(*names, F.explode(F.array("label", "other")).alias("label"), "apart").groupBy(*names, "label").agg(F.min("apart").alias("apart"))
    facts = sparse.join(gaps, [*names, "label"]).join(count.withColumn("label", F.col("label").cast("long")), [*names, "label"])
    all_points = points.groupBy(*names).agg(F.count("*").alias("n"))
    part = F.col("size") / F.col("n") * (F.col("apart") - F.col("sparse")) / F.greatest("apart", "sparse", F.lit(1e-300))
    return _on(facts, all_points, names).groupBy(*names).agg(F.when(F.count("*") > 1, F.sum(part)).alias("raw"))


def cop(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, raw): BL-01 of whole clouds: mean distance to the centroid over the least greatest distance to a point outside."""
    names, blocks = list(keys), blocks_of(points, keys)

    def fold(own: Block, others: list[Block], row) -> pd.DataFrame:
        clusters = np.unique(np.concatenate([o.labels for o in others]))
        most = np.zeros((len(own.ids), len(clusters)))
        for o in others:
            for at, d in own.steps(o):
                for c in np.unique(o.labels):
                    k = int(np.searchsorted(clusters, c))
                    most[at, k] = np.maximum(most[at, k], d[:, o.labels == c].max(1))
        i, c = np.indices(most.shape)
        i, c = i.ravel(), c.ravel()
        outside = own.labels[i] != clusters[c]
        return pd.DataFrame({"point_id": own.ids[i], "other": clusters[c], "most": most.ravel()})[outside]

    found = visit(blocks, block_pairs(blocks, names), names, fold, "point_id long, other long, most double")
    far = found.groupBy(*names, "point_id", "other").agg(F.max("most").alias("most")).groupBy(*names, F.col("other").alias("label")).agg(F.min("most").alias("far"))
    own = points.select(*names, F.col("label").cast("long").alias("label"), "x", "y")
    middle = own.groupBy(*names, "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    off = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    spread = own.join(middle, [*names, "label"]).groupBy(*names, "label").agg(F.sum(off).alias("total"), F.count("*").alias("n"))
    value = F.sum(F.col("total") / F.greatest("far", F.lit(1e-300))) / F.sum("n")
    return spread.join(far, [*names, "label"]).groupBy(*names).agg(F.when(F.count("*") > 1, value).alias("raw"))


def dcsi(points: DataFrame, keys: Sequence[str], min_points: int = 5) -> DataFrame:
    """(keys, raw): BL-12 of whole clouds: mean over pairs of clusters of separation against connectedness of the core points.

    A cluster's radius is the median of its points' distances to the neighbour
    number 2 * min_points (the last there is) within it; core points have
    min_points others within that.
    """
    names = list(keys)
    count = points.groupBy(*names, F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))
    own = points.withColumn("label", F.col("label").cast("long")).join(count.filter(F.col("n") > min_points), [*names, "label"])
    near = written(neighbours(blocks_of(own, names), names, 2 * min_points, same_label=True), "near")
    last = near.groupBy(*names, "label", "point_id").agg(F.max("d").alias("last"), F.max(F.when(F.col("rank") == min_points, F.col("d"))).alias("at"))
    radius = last.groupBy(*names, "label").agg(F.expr("percentile(last, 0.5)").alias("radius"))
    core = last.join(radius, [*names, "label"]).filter(F.col("at") <= F.col("radius")).select(*names, "point_id", "label")
    some = core.groupBy(*names, "label").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    kept = written(own.join(core.join(some, [*names, "label"]), [*names, "point_id", "label"]).select(*names, "point_id", "x", "y", "label", F.lit(0.0).alias("core")), "cores")
    joined = spanning_edges(kept, names).groupBy(*names, "label").agg(F.max("w").alias("joined"))
    other = joined.select(*names, F.col("label").alias("other"), F.col("joined").alias("joined2"))
    q = F.col("apart") / F.greatest("joined", "joined2", F.lit(1e-300))
    both = _gaps(kept, names).join(joined, [*names, "label"]).join(other, [*names, "other"])
    return both.groupBy(*names).agg(F.avg(q / (1 + q)).alias("raw"))


def hdbscan(points: DataFrame, keys: Sequence[str], min_cluster_size: int = 10, min_samples: int = 5) -> DataFrame:
    """(keys, point_id, label) of whole clouds (CLU-06): the tree of mutual reachability is made in tiles; one task reads its edges, n - 1 a cloud.

    points: keys, point_id, x, y.
    """
    from .kernels import condensed

    names = list(keys)
    own = written(points.select(*names, F.col("point_id").cast("long").alias("point_id"), "x", "y", F.lit(0).cast("long").alias("label")), "cloud")
    near = neighbours(blocks_of(own, names), names, min_samples).groupBy(*names, "point_id").agg(F.max("d").alias("core"))
    tree = spanning_edges(own.join(near, [*names, "point_id"]), names)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(rows[["u", "v"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        labels = condensed(len(ids), zip(rows["w"].tolist(), ends[:, 0].tolist(), ends[:, 1].tolist(), strict=True), min_cluster_size)[0]
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in names}, "point_id": ids, "label": labels})

    return tree.groupBy(*(names or [F.lit(1).alias("_one")])).applyInPandas(run, _named(points, names) + "point_id long, label int")


def cvdd(points: DataFrame, keys: Sequence[str], k: int = 7) -> DataFrame:
    """(keys, raw): BL-11 of whole clouds: separation over compactness in minimax paths of density-weighted distances.

    A minimax path lies on the spanning tree. The nearest point outside a
    cluster is over the tree's least edge out of it; within it, an edge is the
    path of all pairs that it joins when edges are added by length.
    """
    names = list(keys)
    own = written(points.select(*names, F.col("point_id").cast("long").alias("point_id"), "x", "y", F.col("label").cast("long").alias("label")), "cloud")
    near = neighbours(blocks_of(own, names), names, k).groupBy(*names, "point_id").agg(F.avg("d").alias("local"))
    most = near.groupBy(*names).agg(F.greatest(F.max("local"), F.lit(1e-300)).alias("most"))
    factor = _on(near, most, names).select(*names, "point_id", (F.col("local") / F.col("most")).alias("core"))
    one = own.join(factor, [*names, "point_id"]).select(*names, "point_id", "x", "y", F.lit(0).cast("long").alias("label"), "core")
    end = lambda c: own.select(*names, F.col("point_id").alias(c), F.col("label").alias(f"l{c}"))
    tree = spanning_edges(one, names, weigh=stretched).join(end("u"), [*names, "u"]).join(end("v"), [*names, "v"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(rows[["u", "v"]].to_numpy(), return_inverse=True)
        label = np.empty(len(ids), np.int64)
        label[ends.ravel()] = rows[["lu", "lv"]].to_numpy().ravel()
        raw = separation_in_tree(zip(rows["w"].tolist(), *ends.reshape(-1, 2).T.tolist(), strict=True), label)
        return pd.DataFrame({**{k: rows[k].iloc[:1].tolist() for k in names}, "raw": pd.Series([raw], dtype="float64")})

    return tree.groupBy(*(names or [F.lit(1).alias("_one")])).applyInPandas(run, _named(points, names) + "raw double")


def separation_in_tree(edges, labels: np.ndarray) -> float | None:
    """CVDD of the spanning tree (length, a, b) of points with labels: separation over compactness of minimax paths."""
    label = labels.tolist()
    root, held = list(range(len(label))), [{c: 1} for c in label]
    size, count = [1] * len(label), {}
    for c in label:
        count[c] = count.get(c, 0) + 1
    total, out = {c: [0.0, 0.0] for c in count}, dict.fromkeys(count, np.inf)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for w, a, b in sorted(edges):
        if label[a] != label[b]:
            out[label[a]], out[label[b]] = min(out[label[a]], w), min(out[label[b]], w)
        a, b = find(a), find(b)
        if size[a] < size[b]:
            a, b = b, a
        for c, n in held[b].items():
            pairs = 2 * n * held[a].get(c, 0)
            total[c][0] += pairs * w
            total[c][1] += pairs * w * w
            held[a][c] = held[a].get(c, 0) + n
        root[b], held[b] = a, {}
        size[a] += size[b]
    value = 0.0
    for c, n in count.items():
        if n > 1:
            mean = total[c][0] / n**2
            spread = np.sqrt(max(0.0, total[c][1] / n**2 - mean**2))
            value += out[c] / max(mean * (1 + spread), 1e-300)
    return float(value / len(count)) if len(count) > 1 else None
