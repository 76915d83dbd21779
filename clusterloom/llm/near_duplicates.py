"""Near-duplicates by word shingles: Jaccard similarity of 0.8 or more.

Texts with equal shingle sets (as 32-bit hashes) are one node, so repeats
within a text play no part and exact copies never meet in a task. Candidates
come first, the sets decide afterwards:

1. SimHash links (vantage-point trees) and stars around the first node of each
   min-hash give most candidate links; they cost a few rows a node.
2. An exact prefix filter gives the rest: in one order of all shingles, two
   sets of that similarity share a shingle among the first
   size - ceil(0.8 size) + 1 of each. Only shingles met by nodes that step 1
   left apart are looked at. Any order is exact; shingles that are common in a
   sample come last, so that few nodes meet by them. Sizes and parity sketches
   (bounds of the sets' difference, never above it) rule pairs out, so no pair
   of the similarity is lost.
3. The nodes of each component of candidates are compared by their sets, which
   travel once. Components beyond a block are cut into blocks that meet in
   pairs: every pair is still compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .simhash import STEP, Forest, linked_fingerprints, majority, merge_forests, shingle_hashes
from .storage import discard, materialize
from .words import trim

#: Nodes, and bytes of sets, that a block holds; a task compares two blocks at most.
BLOCK, BLOCK_BYTES = 2000, 1 << 24
#: Placed nodes for each pack of meetings that a task takes at once.
PACK_NODES = 2000
#: Nodes in which common shingles are looked for: at least so many, and one in so many of all; how many of these must have
#: one, and the most that come last (4 bytes each are sent to the tasks).
ORDER_SAMPLE, ORDER_SHARE, COMMON, MOST_COMMON = 10_000, 1000, 3, 50_000
#: Odd factors of the min-hashes, and the radius of the SimHash links.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
RADIUS = 3
#: Bits of a mark table for each row marked, and the most of them: 8 MB are sent to the tasks, whatever the input.
MARK_BITS, MOST_MARKS = 16, 1 << 26
#: Texts whose facts are held at once.
SLICE = 500
#: Room for rounding in bounds of sizes.
SLACK = 1e-9


def members(hashes: np.ndarray) -> np.ndarray:
    """Sorted set of 32-bit shingle hashes from 64-bit ones."""
    return np.unique((hashes >> np.uint64(32)).astype("<u4"))


def prefix(own: np.ndarray, common: np.ndarray, place: np.ndarray, least: float) -> np.ndarray:
    """The shingles by which a set meets others: its first ones, where those in common (sorted) follow all others by place."""
    n = len(own) - math.ceil(least * len(own) - SLACK) + 1 if len(own) else 0
    at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
    last = common[at] == own if len(common) else np.zeros(len(own), bool)
    late = own[last][np.argsort(place[at[last]], kind="stable")] if last.any() else own[:0]
    return np.concatenate((own[~last], late))[:n].view("<i4")


def sketch(own: np.ndarray) -> bytes:
    """Bits that say whether an odd number of shingles falls on them: two sketches differ in no more bits than their sets in
    shingles. There are as many bits as shingles or up to twice as many, a power of two."""
    width = 1 << max(6, (len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits((np.bincount(own % width, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(bits: np.ndarray) -> np.ndarray:
    """Sketches (rows of 64-bit words) of half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def jaccard(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets; 1 for two empty ones."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate((x, y)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def alike(a: bytes, b: bytes, least: float) -> bool:
    """Whether the similarity is at least so much; sets of too different sizes need no comparison."""
    return min(len(a), len(b)) >= least * max(len(a), len(b)) - SLACK and jaccard(a, b) >= least


def near(m, n, apart, least: float):
    """Whether sizes and differing sketch bits allow the similarity: sets of m and n shingles of similarity s differ in
    (m + n) (1 - s) / (1 + s) of them."""
    return (np.minimum(m, n) >= least * np.maximum(m, n) - SLACK) & (apart <= (m + n) * (1 - least) / (1 + least) + SLACK)


def near_sets(sizes: np.ndarray, sketches: list[bytes], side: np.ndarray, least: float):
    """Positions (q, p) of all pairs that sizes and sketches allow, in steps. Side 1 meets side 0; without any, side 0 meets itself."""
    width = np.array([len(s) // 8 for s in sketches])
    between = bool(side.any())
    held = {w: (own := np.flatnonzero(width == w), np.frombuffer(b"".join(sketches[i] for i in own), "<u8").reshape(-1, w)) for w in np.unique(width).tolist()}
    for w, (wide, bits) in held.items():
        for v in (w, w // 2):
            if v not in held:
                continue
            slim, other = held[v]
            mine = bits if v == w else fold(bits)
            # Within a width each pair once; a pair of two sides either way round.
            ways = [(side[wide] == 1, side[slim] == 0)] + [(side[wide] == 0, side[slim] == 1)] * (v != w) if between else [(wide >= 0, slim >= 0)]
            for asks, owns in ways:
                a, x, b, y = slim[owns], other[owns], wide[asks], mine[asks]
                step = max(1, STEP // max(1, len(a) * v))
                for i in range(0, len(b) if len(a) else 0, step):
                    apart = np.bitwise_count(y[i : i + step][:, None, :] ^ x[None, :, :]).sum(2, dtype=np.int64)
                    q, p = np.nonzero(near(sizes[b[i : i + step]][:, None], sizes[a][None, :], apart, least))
                    q, p = b[i + q], a[p]
                    keep = q > p if v == w and not between else q != p
                    yield q[keep], p[keep]


def link_meeting(sizes: np.ndarray, sketches: list[bytes], side: np.ndarray, least: float, sets: list[bytes] | None = None) -> np.ndarray:
    """Root position of each node, where the sets (or, without them, sizes and sketches) allow the similarity."""
    forest = Forest(len(sizes))
    for q, p in near_sets(sizes, sketches, side, least):
        if sets is None:
            forest.link(q, p)
            continue
        while len(q):
            apart = forest.find(q) != forest.find(p)  # what is linked already needs no proof
            q, p = q[apart], p[apart]
            proved = [alike(sets[i], sets[j], least) for i, j in zip(q[:256].tolist(), p[:256].tolist(), strict=True)]
            forest.link(q[:256][proved], p[:256][proved])
            q, p = q[256:], p[256:]
    return forest.roots()


def _hashes(text: bytes | None, width: int, seed: int) -> np.ndarray:
    return np.array(shingle_hashes(text, width, seed), np.uint64)


#: What is known of each text: node (a hash of its set), size, fp (SimHash of the set), sketch, prefix and mins (min-hashes).
FACTS = "node long, size int, fp long, sketch binary, prefix array<int>, mins array<int>"


def _facts(width: int, seed: int, common: np.ndarray, place: np.ndarray, least: float):
    """FACTS of each text (column 1), beside its key (column 0). Texts are read one by one."""

    def fact(text: bytes | None) -> tuple:
        hashes = np.unique(_hashes(text, width, seed))
        own = members(hashes)
        fp = majority(hashes, np.array([0]))[0] if len(hashes) else np.uint64(0)
        mins = (own[:, None] * FACTORS).min(0).view(np.int32) if len(own) else np.zeros(0, np.int32)
        node = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), seed))
        return node.astype(np.int64), len(own), fp.astype(np.int64), sketch(own), prefix(own, common, place, least), mins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "size", "fp", "sketch", "prefix", "mins"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                own = batch.slice(i, SLICE)
                rows = [fact(t.as_py()) for t in own.column(1)]
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["key", *names])
            trim()

    return run


def _sets(width: int, seed: int, marks):
    """(at, members) of the texts whose hash (column 0) may be marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            few = np.flatnonzero(marks.value.has(at))
            for i in range(0, len(few), SLICE):
                own = few[i : i + SLICE]
                sets = pa.array([members(_hashes(batch.column(1)[j].as_py(), width, seed)).tobytes() for j in own.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at[own]), sets], ["at", "members"])
            trim()

    return run


def common_shingles(texts: DataFrame, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, place of each by frequency) of the shingles that are common in a sample of the texts (column text)."""

    @F.pandas_udf("array<int>")
    def listed(own: pd.Series) -> pd.Series:
        return pd.Series([members(_hashes(t, width, seed)).view("<i4") for t in own], dtype=object)

    every = min(ORDER_SHARE, max(1, texts.count() // ORDER_SAMPLE))
    some = texts.select(F.col("text").cast("binary").alias("text")).filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(every)) == 0).distinct()
    counts = some.select(F.explode(listed("text")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toPandas()
    found = rows["s"].to_numpy(np.int32).view(np.uint32)[::-1]  # rarest first
    order = np.argsort(found)
    return found[order], order


class Marks:
    """A bounded table of bits in which every marked hash has its bit set; others may share one."""

    def __init__(self, hashes: DataFrame, column: str):
        want = max(1 << 16, MARK_BITS * hashes.count())
        self.width = min(MOST_MARKS, 1 << (want - 1).bit_length())
        bit = F.pmod(F.col(column), F.lit(self.width))
        words = hashes.select(F.shiftright(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("b"))
        rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        self.words = np.zeros(self.width // 64, np.int64)
        self.words[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes % self.width
        return (self.words[bit >> 6] >> (bit & 63)) & 1 == 1


def _marked(marks):
    """Whether a hash may be marked; marks is a broadcast Marks."""

    @F.pandas_udf("boolean")
    def run(hashes: pd.Series) -> pd.Series:
        return pd.Series(marks.value.has(hashes.to_numpy(np.int64)))

    return run


def _link(least: float, proved: bool):
    """Forests of all meetings of a pack, by sketches or proved by sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["meeting", "a", "b", "side", "node"], ignore_index=True)
        meeting = rows[["meeting", "a", "b"]].to_numpy()
        starts = np.flatnonzero(np.append(True, (meeting[1:] != meeting[:-1]).any(1)))
        node, side, size, sketches = rows["node"].to_numpy(), rows["side"].to_numpy(), rows["size"].to_numpy(np.int64), rows["sketch"].tolist()
        sets, nodes, roots = rows["members"].tolist() if proved else None, [], []
        for i, z in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            root = link_meeting(size[i:z], sketches[i:z], side[i:z], least, sets and sets[i:z])
            more = np.bincount(root, minlength=z - i)[root] > 1
            nodes.append(node[i:z][more])
            roots.append(node[i:z][root[more]])
        return pd.DataFrame({"node": np.concatenate(nodes), "root": np.concatenate(roots)})

    return run


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with node, meeting and blocks, placed in cells (meeting, a, b): a block meets itself and each other block once."""
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("partner")
    placed = rows.withColumn("own", own).select("*", partner).drop("blocks")
    cell = {"a": F.least("own", "partner"), "b": F.greatest("own", "partner"), "side": F.when(F.col("own") <= F.col("partner"), 0).otherwise(1)}
    return placed.withColumns(cell).drop("own", "partner")


def linked(placed: DataFrame, packs: int, least: float, proved: bool) -> DataFrame:
    """(node, root) of the forests of all cells."""
    packed = placed.withColumn("pack", F.pmod(F.xxhash64("meeting", "a", "b"), F.lit(packs)))
    return materialize(packed.groupBy("pack").applyInPandas(_link(least, proved), "node long, root long"), "forests")


def simhash_links(nodes: DataFrame) -> DataFrame:
    """(node, root) of nodes whose SimHash fingerprints are equal or linked at RADIUS bits or fewer."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "fps")
    near_fp = linked_fingerprints(firsts, RADIUS)
    tied = materialize(firsts.join(near_fp, "fp", "left").filter("label is not null or n > 1"), "tied")
    roots = tied.groupBy(F.coalesce("label", "fp").alias("of")).agg(F.min("first").alias("root"))
    of_fp = tied.select("fp", F.coalesce("label", "fp").alias("of")).join(roots, "of").select("fp", "root")
    return nodes.select("node", "fp").join(of_fp, "fp").select("node", "root")


def star_links(nodes: DataFrame, least: float) -> DataFrame:
    """(node, root) of nodes that sizes and sketches allow to be alike to the smallest node of the same min-hash."""

    @F.pandas_udf("boolean")
    def allowed(size: pd.Series, own: pd.Series, hub_size: pd.Series, hub: pd.Series) -> pd.Series:
        out = []
        for m, a, n, b in zip(size, own, hub_size, hub, strict=True):
            x, y = (np.frombuffer(s, "<u8")[None, :] for s in ((a, b) if len(a) >= len(b) else (b, a)))
            while x.shape[1] > y.shape[1]:
                x = fold(x)
            out.append(bool(near(m, n, int(np.bitwise_count(x ^ y).sum()), least)))
        return pd.Series(out, dtype=bool)

    rows = nodes.select("node", "size", "sketch", F.posexplode("mins").alias("i", "least")).withColumn("meeting", F.xxhash64("i", "least"))
    hubs = rows.groupBy("meeting").agg(F.min(F.struct("node", "size", "sketch")).alias("hub"), F.max("node").alias("last")).filter("hub.node < last")
    met = rows.select("meeting", "node", "size", "sketch").join(hubs.select("meeting", "hub"), "meeting")
    fits = F.col("size").between(F.col("hub.size") * least - SLACK, F.col("hub.size") / least + SLACK)
    return met.filter(fits).filter(allowed("size", "sketch", "hub.size", "hub.sketch")).select("node", F.col("hub.node").alias("root"))


def prefix_links(nodes: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(node, root) of all pairs that share a shingle of their prefixes, have different labels, and may be alike."""
    known = nodes.select("node", "prefix").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.explode("prefix").alias("meeting"))
    crowds = known.groupBy("meeting").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.bit_xor("node").alias("x")).filter("low < high")
    # Shingles that the same nodes share are one meeting.
    crowds = crowds.groupBy("n", "x", "low", "high").agg(F.min("meeting").alias("meeting")).select("meeting", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    member = known.select("node", "meeting").join(crowds, "meeting")
    placed = materialize(in_blocks(member), "meetings")
    packs = max(64, placed.count() // PACK_NODES)
    found = linked(placed.join(nodes.select("node", "size", "sketch"), "node"), packs, least, False)
    discard(placed)
    return found


def proved_links(docs: DataFrame, nodes: DataFrame, labels: DataFrame, width: int, seed: int, least: float) -> DataFrame:
    """(node, root) of the pairs of equal label whose sets are alike. docs has at (hash of the key) and text."""
    own = nodes.select("node", "size", "sketch", F.xxhash64("least").alias("at")).join(labels.withColumnRenamed("label", "meeting"), "node")
    own = materialize(own, "candidates")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.col("size").cast("long")) * 4 / BLOCK_BYTES)).alias("blocks")
    placed = materialize(in_blocks(own.join(own.groupBy("meeting").agg(F.greatest(blocks, F.lit(1)).alias("blocks")), "meeting")), "cells")
    facts = placed.agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long") * 4).alias("bytes")).first()
    packs = max(64, facts.n // PACK_NODES, (facts.bytes or 0) // BLOCK_BYTES)
    marks = docs.sparkSession.sparkContext.broadcast(Marks(own, "at"))
    some = docs.select("at", "text").mapInArrow(_sets(width, seed, marks), "at long, members binary")
    sets = some.groupBy("at").agg(F.first("members").alias("members"))
    found = linked(placed.join(sets, "at").drop("at"), packs, least, True)
    discard(own), discard(placed)
    return found


def near_duplicate_groups(docs: DataFrame, key: F.Column, text_col: str = "text", width: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """(key, group): group is the smallest key of the texts that links reach.

    key may be of any type that can be ordered. Texts without words (null,
    empty, blanks) are copies of one another; texts of fewer words than width
    count as one shingle. Each row of docs gives one row, repeated rows too;
    an empty table gives none. Whole texts count, however long.
    """
    plain = docs.select(key.alias("key"), F.col(text_col).cast("binary").alias("text"))
    common = common_shingles(plain, width, seed)
    told = StructType([plain.schema["key"], *StructType.fromDDL(FACTS)])
    prints = materialize(plain.mapInArrow(_facts(width, seed, *common, least), told), "prints")
    first = F.first(F.struct("size", "fp", "sketch", "prefix", "mins")).alias("f")
    nodes = materialize(prints.groupBy("node").agg(F.min("key").alias("least"), first).select("node", "least", "f.*"), "nodes")
    # A root is a member of its own star, so that the stars it is in meet.
    stars = [simhash_links(nodes), star_links(nodes, least)]
    stars = materialize(reduce(DataFrame.union, [s.union(s.select("root", "root")) for s in stars]), "stars")
    labels = materialize(merge_forests(stars, "node"), "labels")
    rest = prefix_links(nodes, labels, least)
    candidates = materialize(merge_forests(stars.union(rest), "node"), "labels")
    proved = proved_links(plain.select(F.xxhash64("key").alias("at"), "text"), nodes, candidates, width, seed, least)
    final = materialize(nodes.select("node", "least").join(merge_forests(proved, "node"), "node"), "labelled")
    groups = final.join(final.groupBy("label").agg(F.min("least").alias("group")), "label").select("node", "group")
    of_node = nodes.select("node", "least").join(groups, "node", "left").select("node", F.coalesce("group", "least").alias("group"))
    return prints.select("key", "node").join(of_node, "node").select("key", "group")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs, columns as they are, of each group: that of the smallest id, null last.

    Of rows equal in id and text one stays. Extra columns may have any names.
    Only rows that share a key, or may go, are dealt out; the others stay where
    they are.
    """
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    groups = near_duplicate_groups(docs, key, text_col, width, least)
    by_key = groups.groupBy("key").agg(F.count("*").alias("n"), F.min("group").alias("group"))
    touched = materialize(by_key.filter("n > 1 or not key <=> `group`").select(F.xxhash64("key").alias("at"), "key", F.expr("key <=> `group`").alias("stays")), "touched")
    marks = docs.sparkSession.sparkContext.broadcast(Marks(touched, "at"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).withColumn("at", F.xxhash64("key"))
    rows = rows.withColumn("marked", _marked(marks)("at"))
    sole = rows.filter("not marked").select("row.*")
    told = touched.select(F.to_json("key").alias("_key"), "stays")
    met = rows.filter("marked").select("row", F.to_json("key").alias("_key")).join(told, "_key", "left")
    one = met.filter("stays").groupBy("_key").agg(F.first("row").alias("row"))
    return sole.union(met.filter("stays is null").select("row.*")).union(one.select("row.*"))
