"""Exact top-k inner products: one KD-tree a shard, searched best first.

A KD-tree over a bounded sample cuts space into cells; a cell's rows make one
shard or, where it is crowded, several. Each shard becomes one row that holds
its KD-tree (median splits on the widest side, tight bounding boxes), built
once. Queries are packed into blocks by cell. A block visits a shard of its own
cell first, which gives every query a kth score; then only shards whose box may
hold a score at or above that of one of its queries, the most promising ones
before the others, with the kth scores tightened between. Within a shard, boxes
whose best possible inner product is below the kth score are never opened.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize

#: Vectors of a shard, of a leaf, and queries of a block.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 128, 1024
#: Rows from which the cells are planned, and how many of them a cell has at least.
PLAN_ROWS, CELL_SAMPLE = 32_768, 16
#: Query blocks that meet a shard in one task, boxes that meet a block at once, and shards of the second wave.
CHUNK_BLOCKS, CHUNK_BOXES, NEAR_SHARDS = 32, 1024, 4
#: Inner products below this are exact in doubles.
EXACT = float(1 << 53)
PAIR_DDL = "block long, shard long, bound double"
FOUND_DDL = "q_row long, query_id long, row long, vec_id long, score long"


class KDTree:
    """Nodes in preorder; boxes are tight. Rows are permuted so that each node is a range; a leaf's children are -1."""

    def __init__(self, vectors, ids, rows, first, last, children, low, high):
        self.vectors, self.ids, self.rows = vectors, ids, rows
        self.first, self.last, self.children, self.low, self.high = first, last, children, low, high

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> KDTree:
        order, todo = np.arange(len(vectors)), [(0, len(vectors), -1)]
        first, last, lows, highs, children = [], [], [], [], []
        while todo:
            a, b, parent = todo.pop()
            own, node = vectors[order[a:b]], len(first)
            if parent >= 0:
                children[parent][int(children[parent][0] >= 0)] = node
            low, high = own.min(0), own.max(0)
            first.append(a), last.append(b), lows.append(low), highs.append(high), children.append([-1, -1])
            if b - a > LEAF_ROWS and (high > low).any():
                half = (b - a) // 2
                split = np.argpartition(own[:, int(np.argmax(high - low))], half)
                order[a:b] = order[a:b][split]
                todo += [(a, a + half, node), (a + half, b, node)]
        return cls(vectors[order], ids[order], rows[order], *(np.array(x) for x in (first, last, children, lows, highs)))

    def packed(self) -> dict[str, bytes]:
        kinds = {"vectors": "<f8", "ids": "<i8", "rows": "<i8", "first": "<i4", "last": "<i4", "children": "<i4", "low": "<f8", "high": "<f8"}
        return {k: getattr(self, k).astype(t).tobytes() for k, t in kinds.items()}

    @classmethod
    def unpacked(cls, row, width: int) -> KDTree:
        doubles = (np.frombuffer(x, "<f8").reshape(-1, width) for x in (row.vectors, row.low, row.high))
        vectors, low, high = doubles
        ids, rows, first, last = (np.frombuffer(x, t) for x, t in ((row.ids, "<i8"), (row.rows, "<i8"), (row.first, "<i4"), (row.last, "<i4")))
        return cls(vectors, ids, rows, first, last, np.frombuffer(row.children, "<i4").reshape(-1, 2), low, high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that each query can have in each node's box."""
        return box_bounds(queries, self.low, self.high)

    def search(self, query: np.ndarray, own_row: int, bounds: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """The k best (score, -id, -row), best first, of `best` and this tree."""
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if len(best) == k and -bound < best[-1][0]:
                break
            if self.children[node][0] >= 0:
                for child in self.children[node].tolist():
                    if len(best) < k or bounds[child] >= best[-1][0]:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            own = slice(self.first[node], self.last[node])
            scores, ids, rows = self.vectors[own] @ query, self.ids[own], self.rows[own]
            keep = rows != own_row
            if len(best) == k:
                keep &= scores >= best[-1][0]
            if keep.any():
                scores, ids, rows = scores[keep], ids[keep], rows[keep]
                if len(scores) > k:
                    top = np.lexsort((rows, ids, -scores))[:k]
                    scores, ids, rows = scores[top], ids[top], rows[top]
                best = sorted([*best, *zip(scores.tolist(), (-ids).tolist(), (-rows).tolist(), strict=True)], reverse=True)[:k]
        return best


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _exact(vectors: np.ndarray, queries: np.ndarray) -> bool:
    """Whether every inner product of such vectors is exact in doubles."""
    most = float(np.abs(vectors).max(initial=0.0)) * float(np.abs(queries).max(initial=0.0))
    return most * max(1, vectors.shape[1]) < EXACT


def _integers(vectors: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in vectors], object).reshape(vectors.shape)


def plan_cells(points: np.ndarray, cells: int) -> dict[int, tuple[int, float]]:
    """Inner nodes (heap index: side, cut) of a KD-tree with so many leaves, or as many as the points allow."""
    tree, todo = {}, [(-len(points), 0, points)]
    while todo and len(tree) + 1 < cells:
        _, at, own = heapq.heappop(todo)
        if len(own) < 2 * CELL_SAMPLE:
            continue
        side = int(np.argmax(own.max(0) - own.min(0)))
        cut = float(np.median(own[:, side]))
        below = own[:, side] < cut
        if below.any():
            tree[at] = side, cut
            for child, part in ((2 * at + 1, own[below]), (2 * at + 2, own[~below])):
                heapq.heappush(todo, (-len(part), child, part))
    return tree


def find_cells(points: np.ndarray, tree: dict[int, tuple[int, float]]) -> np.ndarray:
    """Heap index of the cell of each point."""
    out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if at not in tree or not len(own):
            out[own] = at
            continue
        side, cut = tree[at]
        below = points[own, side] < cut
        todo += [(2 * at + 1, own[below]), (2 * at + 2, own[~below])]
    return out


def _cells(tree: dict[int, tuple[int, float]], width: int):
    @F.pandas_udf("long")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series(find_cells(_matrix(vectors, width), tree))

    return run


def _shard(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        tree = KDTree.build(_matrix(rows["vector"], width), rows["id"].to_numpy("<i8"), rows["row"].to_numpy("<i8"))
        facts = {"shard": int(rows["shard"].iloc[0]), "box_low": tree.low[0].astype("<f8").tobytes(), "box_high": tree.high[0].astype("<f8").tobytes()}
        return pd.DataFrame({k: [v] for k, v in (facts | tree.packed()).items()})

    return run


def _block(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        data = _matrix(rows["vector"], width).astype("<f8")
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "home": [int(rows["home"].iloc[0])], "q_rows": [rows["row"].to_numpy("<i8").tobytes()], "q_ids": [rows["id"].to_numpy("<i8").tobytes()], "data": [data.tobytes()]})

    return run


def _kth(block, n: int) -> np.ndarray:
    return np.frombuffer(block.kth, "<f8") if isinstance(block.kth, bytes) else np.full(n, -np.inf)


def _visits(width: int, k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Scores of the queries of some blocks (right) in a shard (left)."""
        out: list[tuple] = []
        for shard in left.itertuples():
            tree = KDTree.unpacked(shard, width)
            plain = tree.vectors, tree.low, tree.high
            for block in right.itertuples():
                queries = np.frombuffer(block.data, "<f8").reshape(-1, width)
                if _exact(plain[0], queries):
                    tree.vectors, tree.low, tree.high = plain
                else:
                    tree.vectors, tree.low, tree.high = (_integers(x) for x in plain)
                    queries = _integers(queries)
                q_rows, q_ids, kth = np.frombuffer(block.q_rows, "<i8"), np.frombuffer(block.q_ids, "<i8"), _kth(block, len(queries))
                bounds = tree.bounds(queries)
                for i in np.flatnonzero(bounds[:, 0].astype(float) >= kth):
                    # k placeholders carry the bound: an equal score with any id still enters.
                    start = [(kth[i], float("-inf"), 0)] * k if np.isfinite(kth[i]) else []
                    found = tree.search(queries[i], int(q_rows[i]), bounds[i], start, k)
                    out += [(int(q_rows[i]), int(q_ids[i]), -int(r), -int(n), int(s)) for s, n, r in found if n != float("-inf")]
        return pd.DataFrame(out, columns=["q_row", "query_id", "row", "vec_id", "score"]).astype("int64")

    return run


def _reach(width: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """(block, shard, bound): shards of a chunk of boxes (left) that may hold a score at the kth of a query, and by how much."""
        low, high = (np.array([np.frombuffer(x, "<f8") for x in left[c]]).reshape(-1, width) for c in ("box_low", "box_high"))
        shard, out = left["shard"].to_numpy(), [pd.DataFrame({"block": [], "shard": [], "bound": []})]
        for block in right.itertuples():
            queries = np.frombuffer(block.data, "<f8").reshape(-1, width)
            over = box_bounds(queries, low, high) * (1 + 1e-12) + 1 - _kth(block, len(queries))[:, None]  # room for rounding
            most = over.max(0)
            near = (most >= 0) & (shard != block.home)
            out.append(pd.DataFrame({"block": block.block, "shard": shard[near], "bound": np.minimum(most[near], 1e300)}))
        return pd.concat(out).astype({"block": "int64", "shard": "int64", "bound": "float64"})

    return run


def _visit(shards: DataFrame, blocks: DataFrame, pairs: DataFrame, width: int, k: int) -> DataFrame:
    """Scores of the blocks in the shards that pairs name, about CHUNK_BLOCKS blocks a task; a shard goes only where it is asked."""
    share = Window.partitionBy("shard").orderBy("block")
    dealt = materialize(pairs.select("block", "shard", F.floor((F.row_number().over(share) - 1) / CHUNK_BLOCKS).alias("chunk")), "visits")
    asked = dealt.groupBy(F.col("shard").alias("s"), F.col("chunk").alias("c")).agg(F.lit(1)).select(F.col("s").alias("shard"), F.col("c").alias("chunk")).join(shards, "shard")
    asking = dealt.join(blocks, "block")
    out = materialize(asked.groupBy("shard", "chunk").cogroup(asking.groupBy("shard", "chunk")).applyInPandas(_visits(width, k), FOUND_DDL), "found")
    discard(dealt)
    return out


def _bounded(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Blocks with the kth scores of their queries, in the order of these."""
    best = found.groupBy("q_row").agg(F.slice(F.array_sort(F.collect_list(-F.col("score"))), 1, k).alias("s"))
    kth = best.select("q_row", F.when(F.size("s") >= k, -F.element_at("s", -1)).alias("kth"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                own = np.frombuffer(r.q_rows, "<i8")
                yield pd.DataFrame({"block": r.block, "at": np.arange(len(own)), "q_row": own})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "kth": [rows["kth"].fillna(-np.inf).to_numpy("<f8").tobytes()]})

    asked = blocks.select("block", "q_rows").mapInPandas(listed, "block long, at long, q_row long")
    known = asked.join(kth, "q_row", "left").select("block", "at", F.col("kth").cast("double").alias("kth"))
    return blocks.drop("kth").join(known.groupBy("block").applyInPandas(pack, "block long, kth binary"), "block")


def exact_top_k(vectors: DataFrame, queries: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query row.

    Components x become floor(scale * x). Every row but the query's own is a
    candidate, repeated rows too; ties go to the smaller id. Vectors that are
    null or hold null or non-finite components, and null ids, take no part;
    shorter vectors count as padded with zeros. A repeated query row is asked
    each time. An empty table gives no rows. Scores are exact integers (they
    must fit into a long).
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    given = usable.select(F.col(id_col).cast("long").alias("id"), whole.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = materialize(given.withColumn("row", F.monotonically_increasing_id()), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = facts.n or 0, max(1, facts.width or 0)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [_matrix(b["vector"], width) for b in batches]
        tree = plan_cells(np.concatenate(parts), -(-n // SHARD_ROWS)) if parts else {}
        yield pd.DataFrame([(at, side, cut) for at, (side, cut) in tree.items()], columns=["at", "side", "cut"])

    sample = rows.select("vector").orderBy(F.xxhash64("row")).limit(PLAN_ROWS).coalesce(1)
    # PLAN_ROWS / CELL_SAMPLE nodes at most.
    tree = {r.at: (r.side, r.cut) for r in sample.mapInPandas(plan, "at long, side int, cut double").collect()}
    placed = materialize(rows.withColumn("cell", _cells(tree, width)("vector")), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards"), F.ceil(F.sum(F.col("asks").cast("long")) / BLOCK_ROWS).alias("blocks"))
    first = Window.orderBy("cell")  # as many rows as cells
    sizes = F.broadcast(sizes.select("cell", "shards", "blocks", *((F.sum(c).over(first) - F.col(c)).alias(f"{c}_before") for c in ("shards", "blocks"))))
    spread = lambda c: F.col(f"{c}_before") + F.pmod(F.xxhash64("row"), F.col(c))
    named = placed.join(sizes, "cell").withColumns({"shard": spread("shards"), "home": F.col("shards_before")})
    tree_ddl = "shard long, box_low binary, box_high binary, vectors binary, ids binary, rows binary, first binary, last binary, children binary, low binary, high binary"
    shards = materialize(named.select("shard", "id", "row", "vector").groupBy("shard").applyInPandas(_shard(width), tree_ddl), "shards")
    asked = named.filter("asks").withColumn("block", spread("blocks")).select("block", "home", "id", "row", "vector")
    blocks = materialize(asked.groupBy("block").applyInPandas(_block(width), "block long, home long, q_rows binary, q_ids binary, data binary"), "blocks")
    trees = shards.drop("box_low", "box_high")
    n_blocks, n_shards = blocks.count(), shards.count()
    found = [_visit(trees, blocks.withColumn("kth", F.lit(None).cast("binary")), blocks.select("block", F.col("home").alias("shard")), width, k)]
    seen = blocks.select("block", F.col("home").alias("shard"))
    n_boxes, n_groups = max(1, -(-n_shards // CHUNK_BOXES)), max(1, -(-n_blocks // CHUNK_BLOCKS))
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    boxes = shards.select("shard", "box_low", "box_high", F.pmod(F.col("shard"), F.lit(n_boxes)).cast("int").alias("chunk"), every(n_groups, "group"))
    for most in (NEAR_SHARDS, None):
        bounded = materialize(_bounded(blocks, reduce(DataFrame.union, found), k), "bounded")
        groups = bounded.select("*", F.pmod(F.col("block"), F.lit(n_groups)).cast("int").alias("group"), every(n_boxes, "chunk"))
        pairs = boxes.groupBy("chunk", "group").cogroup(groups.groupBy("chunk", "group")).applyInPandas(_reach(width), PAIR_DDL)
        pairs = pairs.join(seen, ["block", "shard"], "left_anti")
        if most:
            best = Window.partitionBy("block").orderBy(F.desc("bound"), "shard")
            pairs = pairs.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= most)
        pairs = materialize(pairs.select("block", "shard"), "pairs")
        found.append(_visit(trees, bounded, pairs, width, k))
        seen = seen.union(pairs)
    hit = F.struct((-F.col("score")).alias("s"), "vec_id", "row")
    best = reduce(DataFrame.union, found).groupBy("q_row", "query_id").agg(F.slice(F.array_sort(F.collect_list(hit)), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def top_k_digest(embeddings: DataFrame) -> DataFrame:
    """The result of the registered query: ids divisible by 50 ask for 5 rows."""
    return exact_top_k(embeddings, F.col("vec_id") % 50 == 0)
