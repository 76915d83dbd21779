"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target
over source size. The whole part is kept; the fractional parts are paired, and
mass moves at random from one of the pair to the other until one of them is
integral. Partners are of like size, taken from long to short. Moves are measured in words, so the
expected words of a pair never change. A part of a source leaves one undecided document at most; these
residuals are paired again in a reduction tree until one is left a source,
which is rounded to the nearer side. Where a few documents hold much of a
source that may still be a large share; the miss is made up by single copies
more or less of the documents whose size is nearest to it.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .words import split_words

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is never taken more often than this.
MOST = 3.0
#: Documents that one task pairs, and residuals that meet in one node of the tree.
PART_ROWS, FAN_IN = 2_000, 64
#: Documents of a source that may make up for what its last residual missed, one a round.
REPAIRS = 8
#: Sources whose totals may be broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Target size of each source: shares of all sizes by weight, at most `most` times its size.

    What a source cannot take is shared again among the others by weight.
    Sources are ordered by code point, null last.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out, rest = dict(order), {}, float(sum(n for _, n in order))
    open_ = list(size)
    while open_:
        total = sum(weight[s] for s in open_)
        wish = {s: rest * weight[s] / total for s in open_}
        above = [s for s in open_ if wish[s] > most * size[s]]
        if not above:
            return out | wish
        for s in above:
            out[s] = most * size[s]
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def coin(*key) -> float:
    """A number in [0, 1) that depends on the key only."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(a: tuple, b: tuple, seed) -> tuple[tuple, tuple | None]:
    """Settle one of two documents (key, size, p): (settled, left over or None).

    Mass moves in words: size * p summed over the two stays, and each p is a
    martingale. Sizes are above 0 and 0 < p < 1.
    """
    (ka, na, pa), (kb, nb, pb) = a, b
    up = min((1 - pa) * na, pb * nb)  # words that a can gain from b
    down = min(pa * na, (1 - pb) * nb)
    if coin(seed, ka, kb) * (up + down) < down:
        moved = up
    else:
        moved = -down
    qa, qb = pa + moved / na, pb - moved / nb
    ends = [(abs(q - round(q)) < 1e-9, k, n, q) for k, n, q in ((ka, na, qa), (kb, nb, qb))]
    if ends[0][0] and ends[1][0]:
        return ((ka, na, round(qa)), (kb, nb, round(qb))), None
    done, left = ends if ends[0][0] else ends[::-1]
    return ((done[1], done[2], round(done[3])),), left[1:]


def settle(rows: list[tuple], seed) -> tuple[list[tuple], tuple | None]:
    """All documents settled but one at most."""
    done, left = [], None
    for row in rows:
        if left is None:
            left = row
            continue
        settled, left = pivot(left, row, seed)
        done += settled
    return done, left


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 9, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies) of each row of docs.

    size is the number of words (null text: 0). copies differs from target over
    source size by less than 1; documents without words get the whole part of
    it. The choice depends on ids, sizes, text hashes, sources and the seed
    alone, so reruns agree. Rows equal in all of these are interchangeable.
    Sources are a dimension: one total a source reaches the driver. An empty
    table gives no rows; texts are counted whole, however long; extra columns
    are not read.
    """
    count = F.pandas_udf(_sizes, "long")
    text = F.col(text_col).cast("binary")
    sketch = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), count(text).alias("size")),
        "sizes",
    )
    per = [(r.source, r.rows, r.n) for r in sketch.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("n")).collect()]
    spark, goal = docs.sparkSession, targets([(s, n) for s, _, n in per], weights, most)
    plan = spark.createDataFrame(
        [(i, s, n, float(goal[s]), min(most, goal[s] / n) if n else 0.0, max(1, -(-rows // PART_ROWS))) for i, (s, rows, n) in enumerate(sorted(per, key=lambda x: (x[0] is None, x[0] or "")))],
        "src int, source string, source_size long, target double, rate double, parts long",
    )
    small = F.broadcast(plan) if len(per) <= BROADCAST_SOURCES else plan
    known = sketch.withColumnRenamed("source", "_source").join(small, F.col("_source").eqNullSafe(F.col("source")), "left").drop("_source")
    # Equal rows are counted, and dealt out PART_ROWS at a time.
    alike = known.groupBy("src", "parts", "rate", "doc_id", "text_hash", "size").agg(F.count("*").alias("m"))
    packs = alike.withColumn("pack", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / PART_ROWS))))
    packs = packs.withColumn("m", F.least(F.col("m") - F.col("pack") * PART_ROWS, F.lit(PART_ROWS)))
    packs = packs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash", "pack", F.lit(seed)), F.col("parts")))
    dealt = materialize(packs.groupBy("src", "part").applyInPandas(_first_round(seed), f"{_ddl(sketch)}, src int, part long, copies int, p double"), "dealt")
    open_ = dealt.filter("p is not null").select("src", "part", "size", "p")
    settled = None
    most_parts = max((-(-rows // PART_ROWS) for _, rows, _ in per), default=1)
    width = 1
    while True:
        last = width >= most_parts
        width *= FAN_IN
        level = materialize(
            open_.withColumn("node", F.floor(F.col("part") / width)).groupBy("src", "node").applyInPandas(_next_round(seed, last), "src int, part long, size long, p double, up int"),
            "residuals",
        )
        done = level.filter("up is not null").select("src", "part", "up")
        settled = done if settled is None else settled.union(done)
        open_ = level.filter("up is null").select("src", "part", "size", "p")
        if last:
            break
    sure = dealt.filter("p is null").select("src", "doc_id", "text_hash", "size", "copies")
    # One residual a source and part at most.
    late = dealt.filter("p is not null").join(settled, ["src", "part"]).select("src", "doc_id", "text_hash", "size", (F.col("copies") + F.col("up")).alias("copies"))
    taken = materialize(sure.union(late).withColumn("uid", F.monotonically_increasing_id()), "copies")
    rates = {i: min(most, goal[s] / n) if n else 0.0 for i, (s, _, n) in enumerate(sorted(per, key=lambda x: (x[0] is None, x[0] or "")))}
    flips = _repairs(taken, {i: float(goal[s]) for i, (s, _, _) in enumerate(sorted(per, key=lambda x: (x[0] is None, x[0] or "")))}, rates)
    facts = small.select("src", "source", "source_size", "target")
    mended = taken.join(F.broadcast(flips), "uid", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return mended.join(facts, "src").select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies")


def _repairs(taken: DataFrame, goal: dict[int, float], rates: dict[int, float]) -> DataFrame:
    """(uid, more): REPAIRS documents a source at most that take one copy more or less, so that it comes nearer its goal.

    Copies stay between the whole numbers around the source's rate. Of equally
    good documents the one with the smallest id, then text hash, is taken.
    """
    spark = taken.sparkSession
    missed = {r.src: goal[r.src] - r.n for r in taken.groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect()}
    moved: list[tuple[int, int]] = []
    for _ in range(REPAIRS):
        rows = [(s, float(m), int(rates[s])) for s, m in missed.items() if 1e-9 < rates[s] - int(rates[s]) < 1 - 1e-9 and abs(m) > 0.5]
        if not rows:
            break
        open_ = spark.createDataFrame(rows, "src int, missed double, whole int")
        near = taken.join(F.broadcast(open_), "src").filter(F.when(F.col("missed") > 0, F.col("copies") == F.col("whole")).otherwise(F.col("copies") > F.col("whole")))
        gain = F.abs("missed") - F.abs(F.abs("missed") - F.col("size"))
        best = near.withColumn("gain", gain).filter(F.col("gain") > 0.5)
        if moved:
            best = best.join(F.broadcast(spark.createDataFrame(moved, "uid long, more int")), "uid", "left_anti")
        # A source's best document: one row a source.
        picked = best.groupBy("src").agg(F.min(F.struct((-F.col("gain")).alias("g"), "doc_id", "text_hash", "uid", "size")).alias("b"), F.max("missed").alias("missed")).collect()
        for r in picked:
            step = 1 if r.missed > 0 else -1
            moved.append((r.b.uid, step))
            missed[r.src] -= step * r.b.size
        if not picked:
            break
    return spark.createDataFrame(moved, "uid long, more int")


def _ddl(sketch: DataFrame) -> str:
    return f"doc_id {sketch.schema['doc_id'].dataType.simpleString()}, text_hash long, size long"


def _sizes(texts: pd.Series) -> pd.Series:
    return pd.Series([len(split_words(t)) for t in texts], dtype="int64")


def _first_round(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Of two the longer is left over more often; from long to short, what is left at the end is among the shortest.
        rows = rows.sort_values(["size", "doc_id", "text_hash", "pack"], ascending=[False, True, True, True], ignore_index=True)
        rows = rows.loc[rows.index.repeat(rows["m"])].reset_index(drop=True)
        rate = float(rows["rate"].iloc[0])
        whole, share = int(rate), rate - int(rate)
        copies, p = [whole] * len(rows), [None] * len(rows)
        if 1e-9 < share < 1 - 1e-9:
            source = int(rows["src"].iloc[0])
            asked = [(i, n, share) for i, n in enumerate(rows["size"].tolist()) if n > 0]
            done, left = settle(asked, (seed, source, int(rows["part"].iloc[0])))
            for i, _, up in done:
                copies[i] += up
            if left:
                p[left[0]] = left[2]
        elif share >= 0.5:
            copies = [whole + 1] * len(rows)
        out = rows[["doc_id", "text_hash", "size", "src", "part"]].copy()
        return out.assign(copies=copies, p=pd.Series(p, dtype="float64"))

    return run


def _next_round(seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "part"], ascending=[False, True], ignore_index=True)
        source = int(rows["src"].iloc[0])
        done, left = settle([(k, int(n), p) for k, n, p in zip(rows["part"].tolist(), rows["size"], rows["p"], strict=True)], (seed, source, "tree"))
        if left and last:
            done.append((left[0], left[1], int(left[2] >= 0.5)))
            left = None
        out = [(source, k, n, None, up) for k, n, up in done] + ([(source, left[0], left[1], left[2], None)] if left else [])
        return pd.DataFrame(out, columns=["src", "part", "size", "p", "up"]).astype({"p": "float64", "up": "Int32"})

    return run


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 9) -> DataFrame:
    """Rows of docs, columns as they are, each as often as mix() takes it.

    Copies are looked up by id, text hash and source (nulls are values of their
    own); of rows equal in these the copies are shared out in order. An empty
    table gives no rows; extra columns may have any names.
    """
    taken = mix(docs, id_col, text_col, source_col, seed).select("doc_id", "source", "text_hash", "copies")
    same = ["_id", "_source", "_hash"]
    asked = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.xxhash64(F.col(text_col).cast("binary")).alias("_hash"))
    nth = Window.partitionBy(*same)
    found = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), "copies")
    # One key on both sides, so that rows with nulls meet too.
    key = F.xxhash64(*same, *(F.col(c).isNull() for c in same))
    found = found.withColumn("_n", F.row_number().over(nth.orderBy(F.desc("copies")))).filter("copies > 0").select(key.alias("_key"), "_n", "copies")
    numbered = asked.withColumn("_n", F.row_number().over(nth.orderBy("_hash"))).select("row", key.alias("_key"), "_n")
    times = numbered.join(found, ["_key", "_n"])
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query: taken is copies times size."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
