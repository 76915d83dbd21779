"""Embedding near-duplicates: sorted projection passes with bounded neighbour windows.

Each pass orders all different vectors by the concatenated signs of its own
random projections and compares every vector with the next ones in that order.
Verified pairs of a pass become forests at once and forests of all passes
components, so no pair list is ever written. Links are then counted within the
components: angles to a component's centre settle most pairs of a crowded one
by the triangle inequality, the rest are compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import Forest
from .storage import discard, materialize

#: Neighbours that each vector is compared with in a pass, share of pairs at the threshold that passes are meant to find,
#: and passes that are sorted at once (each moves every vector once).
WINDOW, RECALL, PASSES_AT_ONCE = 64, 0.99, 4
#: Signs of a key, and vectors of a range partition at least.
KEY_BITS, PART_ROWS = 62, 8192
#: Vectors of a component that is compared whole, of one that packs many such, and of a block of larger ones.
WHOLE, PACK, BLOCK = 256, 4096, 1024
#: Angle classes up to the linking angle, and the room left for rounding of angles (radians).
CLASSES, ROOM = 32, 1e-7
#: Cosines this near the threshold are summed anew without rounding error.
DOUBT = 1e-9
EDGE_DDL = "pass int, border long, tail boolean, key long, node long, root long, data binary"
NODE_DDL = "node long, data binary"


def unit_rows(data, width: int) -> np.ndarray:
    """Vectors packed as doubles, divided by their lengths."""
    out = np.frombuffer(b"".join(data), "<f8").reshape(-1, width)
    out = out / np.abs(out).max(1, keepdims=True)  # no square overflows
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of each row of a with each of b is least or more."""
    cosines = a @ b.T
    out = cosines >= least
    for i, j in np.argwhere(np.abs(cosines - least) < DOUBT):
        out[i, j] = math.fsum(a[i] * b[j]) / math.sqrt(math.fsum(a[i] * a[i]) * math.fsum(b[j] * b[j])) >= least
    return out


def window_forest(units: np.ndarray, window: int, least: float) -> np.ndarray:
    """Root position of each row, where rows at most window apart are linked by their cosine."""
    forest = Forest(len(units))
    for a in range(0, len(units), window):
        near = linked(units[a : a + window], units[a : a + 2 * window], least)
        i, j = np.nonzero(near)
        keep = (j > i) & (j - i <= window)
        forest.link(i[keep] + a, j[keep] + a)
    return forest.roots()


def passes_for(n: int, window: int, least: float, recall: float) -> int:
    """Passes after which a pair at the threshold has met with the wanted chance.

    Two vectors meet where they agree in about log2(n / window) leading signs;
    one sign agrees with chance 1 - angle / pi.
    """
    meet = (1 - math.acos(least) / math.pi) ** math.log2(max(2.0, n / window))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def projections(seed: int, number: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, number]).standard_normal((width, KEY_BITS))


def _packer(width: int):
    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.pad(np.asarray(v, "<f8"), (0, width - len(v))).tobytes() for v in vectors], dtype=object)

    return run


def _keys(numbers: range, width: int, seed: int):
    weights = 1 << np.arange(KEY_BITS, dtype=np.int64)[::-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            units = unit_rows(b["data"], width) if len(b) else np.zeros((0, width))
            for p in numbers:
                yield b.assign(key=((units @ projections(seed, p, width)) > 0) @ weights, **{"pass": p})

    return run


def _trees(nodes: np.ndarray, roots: np.ndarray, number: int) -> pd.DataFrame:
    """Rows of the nodes that have another in their tree."""
    more = np.bincount(roots, minlength=len(nodes))[roots] > 1
    return pd.DataFrame({"pass": number, "border": -1, "tail": False, "key": 0, "node": nodes[more], "root": nodes[roots[more]], "data": None})


def _windows(width: int, window: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Forests within a sorted partition, and its first and last rows of each pass, which meet those of its neighbours."""
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), None, None
        border = lambda rows, at, tail: rows.assign(border=at, tail=tail, root=-1)
        for b in batches:
            for p in b["pass"].drop_duplicates().tolist():
                own = b[b["pass"] == p]
                if p == number:
                    first = part if seen < window else None  # the head is still open
                    head = own.iloc[: max(0, window - seen)]
                    seen += len(own)
                    own = pd.concat([held, own])
                else:
                    if held is not None:
                        yield border(held, part + 1, True)
                    first, head, seen, number = part, own.iloc[:window], len(own), p
                if first is not None and len(head):
                    yield border(head, first, False)
                yield _trees(own["node"].to_numpy(), window_forest(unit_rows(own["data"], width), window, least), p)
                held = own.iloc[-window:]
        if held is not None:
            yield border(held, part + 1, True)

    return run


def _borders(width: int, window: int, least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "node"])
        roots = window_forest(unit_rows(rows["data"], width), window, least)
        return _trees(rows["node"].to_numpy(), roots, 0)[["node", "root"]]

    return run


def _forests(nodes: DataFrame, n: int, width: int, least: float, window: int, recall: float, seed: int) -> DataFrame:
    """(node, root) of the verified pairs of all passes."""
    spark, out = nodes.sparkSession, None
    passes = passes_for(n, window, least, recall)
    for a in range(0, passes, PASSES_AT_ONCE):
        numbers = range(a, min(passes, a + PASSES_AT_ONCE))
        keyed = nodes.select("node", "data").mapInPandas(_keys(numbers, width, seed), f"{NODE_DDL}, key long, pass int")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(numbers) // PART_ROWS)
        order = "pass", "key", "node"
        ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = materialize(ordered.mapInPandas(_windows(width, window, least), EDGE_DDL), "pass")
        met = found.filter("border >= 0").groupBy("pass", "border").applyInPandas(_borders(width, window, least), "node long, root long")
        forests = materialize(found.filter("border < 0").select("node", "root").union(met), "forests")
        discard(found)
        out = forests if out is None else out.union(forests)
    return out


def _component_labels(forests: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have a link; equal labels: connected."""
    edges = forests.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return connected_components(edges.distinct()).select("node", F.col("component").alias("label"))


def _count_whole(width: int, least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "node"])
        units, copies, label = unit_rows(rows["data"], width), rows["copies"].to_numpy(np.int64), rows["label"].to_numpy()
        starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        parts = [linked(units[a:z], units[a:z], least) @ copies[a:z] for a, z in zip(starts, np.append(starts[1:], len(rows)), strict=True)]
        return pd.DataFrame({"node": rows["node"].to_numpy(), "near": np.concatenate(parts)})

    return run


def _sums(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                units, (labels, own) = unit_rows(b["data"], width), np.unique(b["label"], return_inverse=True)
                total = np.zeros((len(labels), width))
                np.add.at(total, own, units)
                yield pd.DataFrame({"label": labels, "sum": [t.tobytes() for t in total]})

    return run


def _centre(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sum")  # the same order of addition each time
        total = np.frombuffer(b"".join(rows["sum"]), "<f8").reshape(-1, width).sum(0)
        return pd.DataFrame({"label": rows["label"].iloc[:1], "centre": [total.tobytes() if np.abs(total).max() > 0 else np.eye(1, width).tobytes()]})

    return run


def _angles(width: int):
    @F.pandas_udf("double")
    def run(data: pd.Series, centre: pd.Series) -> pd.Series:
        return pd.Series(np.arccos(np.clip((unit_rows(data, width) * unit_rows(centre, width)).sum(1), -1, 1)))

    return run


def _count_blocks(width: int, least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows["left"] == x] for x in (True, False))
        if left.empty or right.empty:  # a block with itself comes once; the other side may have no rows
            if left.empty or not left["alone"].iloc[0]:
                return pd.DataFrame({"node": [], "near": []}).astype("int64")
            right = left
        near = linked(unit_rows(left["data"], width), unit_rows(right["data"], width), least)
        out = pd.DataFrame({"node": left["node"], "near": near @ right["copies"].to_numpy(np.int64)})
        if right is not left:
            out = pd.concat([out, pd.DataFrame({"node": right["node"], "near": left["copies"].to_numpy(np.int64) @ near})])
        return out

    return run


def _count_large(members: DataFrame, width: int, least: float) -> DataFrame:
    """(node, near) rows whose sums are the copies of a node's linked nodes, its own included."""
    partial = members.select("label", "data").mapInPandas(_sums(width), "label long, sum binary")
    centres = partial.groupBy("label").applyInPandas(_centre(width), "label long, centre binary")
    step = math.acos(least) / CLASSES
    cls = F.floor((_angles(width)("data", "centre") + ROOM) / step).cast("int").alias("cls")
    placed = materialize(members.join(centres, "label").select("label", "node", "copies", "data", cls), "angles")
    classes = materialize(placed.groupBy("label", "cls").agg(F.count("*").alias("n"), F.sum("copies").alias("total")), "classes")
    a, b = classes.select("label", "cls", "n"), classes.select("label", F.col("cls").alias("other"), F.col("n").alias("m"), "total")
    both = a.join(b, "label")  # classes of a component: pi / step at most, whatever its size
    sure = both.filter(F.col("cls") + F.col("other") + 2 <= CLASSES).groupBy("label", "cls").agg(F.sum("total").alias("near"))
    by_class = placed.join(sure, ["label", "cls"]).select("node", "near")
    blocks = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.col(c) - 1) / BLOCK).cast("int")))
    open_pairs = both.filter((F.col("cls") + F.col("other") + 2 > CLASSES) & (F.col("cls") <= F.col("other")) & (F.col("other") - F.col("cls") < CLASSES + 2))
    tasks = open_pairs.select("label", "cls", "other", "m", blocks("n").alias("block")).select("label", "cls", "other", "block", blocks("m").alias("facing"))
    tasks = materialize(tasks.filter("cls < other or block <= facing").withColumn("task", F.monotonically_increasing_id()), "tasks")
    n_blocks = F.floor((F.col("n") - 1) / BLOCK) + 1
    dealt = placed.join(classes.select("label", "cls", "n"), ["label", "cls"]).withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int")).drop("n")
    one = tasks.select("task", "label", "cls", "block", ((F.col("cls") == F.col("other")) & (F.col("block") == F.col("facing"))).alias("alone"), F.lit(True).alias("left"))
    two = tasks.filter("cls < other or block < facing").select("task", "label", F.col("other").alias("cls"), F.col("facing").alias("block"), F.lit(False).alias("alone"), F.lit(False).alias("left"))
    rows = dealt.join(one.union(two), ["label", "cls", "block"]).select("task", "left", "alone", "node", "copies", "data")
    return by_class.union(rows.groupBy("task").applyInPandas(_count_blocks(width, least), "node long, near long"))


def linked_vectors(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", window: int = WINDOW, recall: float = RECALL, seed: int = 7, whole: int = WHOLE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: rows link at a cosine of least or more.

    Components are those of the pairs that sorted passes find; n_links counts
    every other row of the component with such a cosine, found in a pass or not.
    A link is missed only where no chain of found pairs joins its two rows; the
    number of passes follows from the number of vectors and from recall, the
    share of pairs at the threshold that are found directly. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing.
    Shorter vectors count as padded with zeros. Equal vectors are one node with
    copies, so repeated rows cost no comparison; each gets a row. A null id
    takes part and counts as a link, is no component's smallest id, and is kept
    only where its component has no id. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(finite, F.lit(False))
    width = max(1, given.filter(usable).agg(F.max(F.size("vector"))).first()[0] or 0)
    rows = materialize(given.select("vec_id", F.when(usable, _packer(width)(F.when(usable, F.col("vector")).otherwise(F.array().cast("array<double>")))).alias("data")), "vectors")
    distinct = rows.filter("data is not null").groupBy("data").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    labels = _component_labels(_forests(nodes, n, width, least, window, recall, seed))
    members = materialize(nodes.join(labels, "node"), "members")
    sizes = materialize(members.groupBy("label").agg(F.count("*").alias("size"), F.min("least").alias("component_id")), "sizes")
    sized = members.join(sizes.select("label", "size"), "label")
    small = sized.filter(F.col("size") <= whole)
    packs = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PACK)
    pack = F.pmod(F.xxhash64("label"), F.lit(packs)).alias("pack")
    counted = small.select("label", "node", "copies", "data", pack).groupBy("pack").applyInPandas(_count_whole(width, least), "node long, near long")
    large = materialize(sized.filter(F.col("size") > whole).select("label", "node", "copies", "data"), "large")
    if large.limit(1).count():
        counted = counted.union(_count_large(large, width, least))
    near = counted.groupBy("node").agg(F.sum("near").alias("near"))
    facts = members.select("node", "label").join(near, "node").join(sizes.select("label", "component_id"), "label").select("node", "near", "component_id")
    by_data = materialize(nodes.join(facts, "node", "left").select("data", F.coalesce("near", "copies").alias("near"), F.coalesce("component_id", "least").alias("component_id")), "facts")
    joined = rows.join(by_data, "data", "left")
    own = F.when(F.col("data").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce(F.col("near") - 1, F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
