"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a link key (for the query: equal texts) are neighbours.
Members of one group are interchangeable, so labels are propagated on cells
(key, shard, count) instead of on single rows: at most n_shards cells a key,
whatever the size of the group. Rows start where a hash puts them. In a round
every cell wishes to join the shard that holds most of its key. Wishes are
summed by pair of shards; what flows both ways changes no size, and what flows
one way is made up for by whole keys that go the other way, so that shards keep
within their quotas; wishes beyond that wait for the next round. Keys of more
than a part of a quota are packed on the driver. Rows are dealt to the cells at
the end by a rank within (key, salt), so that no group meets in one task.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize

#: Rows of one link key that one task may rank.
ROWS_PER_SALT = 1_000_000
#: Parts in which the rows of a shard are ranked.
RANK_PARTS = 1024
#: Rows of a shard for each of its parts, beyond RANK_PARTS of them, and the most parts.
PART_ROWS, MOST_RANK_PARTS = 1_000_000, 1 << 16
#: Keys of more than this part of a quota are packed one by one, n_shards * LARGE at most.
LARGE = 4
#: Rows above the quotas that the last step settles key by key; it looks at some four times as many.
LAST = 50_000
#: Rounds without progress after which propagation ends.
PATIENCE = 4


def _hash01(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def pack_large(keys: list[tuple[object, int]], free: list[int]) -> list[tuple[object, int, int]]:
    """(key, shard, n) of keys, largest first, each in the shard with most room or, where it is too large, in several. free is used up."""
    out = []
    for key, n in sorted(keys, key=lambda x: (-x[1], str(x[0]))):
        while n > 0:
            shard = max(range(len(free)), key=lambda s: (free[s], -s))
            part = min(n, free[shard])
            free[shard] -= part
            n -= part
            out.append((key, shard, part))
    return out


def start_cells(linked: DataFrame, quotas: list[int]) -> tuple[DataFrame, DataFrame, list[int]]:
    """(cells of packed keys, cells (key, shard, n, size) of the others by hash, room left) of linked rows (key, uid)."""
    free, limit = list(quotas), max(quotas) // LARGE
    counts = linked.groupBy("key", F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(len(quotas))).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("size", F.sum("n").over(Window.partitionBy("key"))), "cells")
    keys = counts.filter(F.col("size") > limit).groupBy("key").agg(F.max("size").alias("n"))
    large = pack_large([(r.key, r.n) for r in keys.collect()], free)
    packed = linked.sparkSession.createDataFrame(large, f"key {linked.schema['key'].dataType.simpleString()}, shard int, n long")
    return packed, counts.filter(F.col("size") <= limit), free


def admitted(wishes: list[list[int]], load: list[int], quotas: list[int], movable: list[int]) -> tuple[list[list[float]], list[list[int]]]:
    """(share of each wished flow that goes, rows of whole keys that go from shard to shard) so that quotas hold.

    wishes[s][t]: rows of shard s that wish to go to t; movable[s]: rows of
    whole keys of s. What a shard gains above its quota leaves as whole keys;
    what these cannot make up for is not let in.
    """
    n = range(len(quotas))
    share = [[1.0] * len(quotas) for _ in n]
    flow = lambda s, t: wishes[s][t] * share[s][t]
    after = lambda s: load[s] - sum(flow(s, t) for t in n) + sum(flow(t, s) for t in n)
    for _ in range(200):
        excess = {s: after(s) - quotas[s] - movable[s] for s in n}
        worst = max(n, key=lambda s: excess[s])
        gain = sum(flow(t, worst) for t in n)
        if excess[worst] < 1 or gain <= 0:
            break
        keep = max(0.0, 1 - excess[worst] / gain)
        for t in n:
            share[t][worst] *= keep
    over = [max(0, min(movable[s], int(after(s) - quotas[s]))) for s in n]
    room = [max(0, int(quotas[t] - after(t))) for t in n]
    whole = [[0] * len(quotas) for _ in n]
    for s in n:
        for t in n:
            part = min(over[s], room[t])
            whole[s][t] = part
            over[s] -= part
            room[t] -= part
    return share, whole


def _lookup(matrix: list[list[float]], row: F.Column, column: F.Column) -> F.Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in line)) for line in matrix))[row][column]


def cut_rows(cells: DataFrame) -> int:
    """Rows that are not in the shard that holds most of their key."""
    most = cells.groupBy("key").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return most.agg(F.sum(F.col("all") - F.col("most"))).first()[0] or 0


def propagate(start: DataFrame, quotas: list[int], max_rounds: int | None = None, seen: list[int] | None = None) -> DataFrame:
    """Cells (key, shard, n, size) after balanced label propagation from the cells of start.

    Rounds go on until no row wishes to move, PATIENCE rounds have not lowered
    the number that do, or for max_rounds. seen gets that number before each round.
    """
    shards, cells, least, idle = len(quotas), start, None, 0
    limit = max(1, max(quotas) // 8)
    for step in itertools.count() if max_rounds is None else range(max_rounds):
        load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        # Equal cells of a key take turns in being its shard, so that what one round refuses another may take.
        rank = F.struct("n", F.xxhash64("key", "shard", F.lit(step)).alias("tie"), "shard")
        best = cells.groupBy("key").agg(F.max(rank).alias("best"))
        led = cells.join(best, "key").select("key", "shard", "n", "size", F.col("best.shard").alias("target"))
        facts = led.groupBy("shard", "target", (F.col("n") == F.col("size")).alias("whole")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") <= limit, F.col("n")).otherwise(0)).alias("light"))
        wishes, movable = [[0] * shards for _ in range(shards)], [0] * shards
        for r in facts.collect():  # the square of the shards at most, twice
            if r.shard != r.target:
                wishes[r.shard][r.target] += r.n
            elif r.whole:
                movable[r.shard] += r.light
        loads = [load.get(s, 0) for s in range(shards)]
        share, whole = admitted(wishes, loads, quotas, movable)
        wished = sum(map(sum, wishes))
        if seen is not None:
            seen.append(wished)
        least, idle = (wished, 0) if least is None or wished < least else (least, idle + 1)
        if not wished and sum(map(sum, whole)) <= LAST or idle >= PATIENCE:
            break
        moves = F.floor(F.col("n") * _lookup(share, F.col("shard"), F.col("target")) + _hash01("key", "shard", F.lit(step)))
        # A whole key goes to the shard in whose interval its hash lies.
        ends = [[sum(whole[s][: t + 1]) / max(1, movable[s]) for t in range(shards)] for s in range(shards)]
        chance = _hash01("key", F.lit(step + 1_000_003))
        upto = F.array(*(F.array(*(F.lit(float(v)) for v in line)) for line in ends))[F.col("shard")]
        gone = F.size(F.filter(upto, lambda v: v <= chance)).cast("int")
        light = (F.col("n") == F.col("size")) & (F.col("n") <= limit) & (gone < shards)
        away = F.col("shard") != F.col("target")
        sent = F.when(away, F.least(F.col("n"), moves)).when(light, F.col("n")).otherwise(F.lit(0)).cast("long")
        to = F.when(away, F.col("target")).when(light, gone).otherwise(F.col("shard"))
        placed = materialize(led.withColumns({"sent": sent, "to": to}), "moves")
        parts = F.explode(F.array(F.struct("shard", (F.col("n") - F.col("sent")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("sent").alias("n")))).alias("part")
        after = placed.select("key", "size", parts).select("key", "size", "part.shard", "part.n").filter("n > 0").groupBy("key", "shard").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
        after = materialize(after.select("key", "shard", "n", "size"), "cells")
        discard(placed)
        if cells is not start:
            discard(cells)
        cells = after
    return cells


def fitted(keys: dict[int, list[tuple[object, int]]], over: list[int], room: list[int]) -> list[tuple[object, int, int, int]]:
    """(key, shard, to, n): cells that leave the shards above their quotas, whole where they fit; the last piece of a gap is cut."""
    over, room, out = list(over), list(room), []
    for s, listed in sorted(keys.items()):
        for whole in (True, False):
            rest = []
            for key, n in sorted(listed, key=lambda x: (-x[1], str(x[0]))):
                while n and over[s]:
                    t = max(range(len(room)), key=lambda i: (min(n, over[s], room[i]), -room[i], -i))
                    part = min(n, over[s], room[t])
                    if not part or whole and part < n:
                        break
                    out.append((key, s, t, part))
                    over[s], room[t], n = over[s] - part, room[t] - part, n - part
                if n:
                    rest.append((key, n))
            listed = rest
    return out


def settle(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """cells (key, shard, n) without those rows above the quotas that LAST allows to settle."""
    load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    loads = [load.get(s, 0) for s in range(len(quotas))]
    over, room = [max(0, x - q) for x, q in zip(loads, quotas, strict=True)], [max(0, q - x) for x, q in zip(loads, quotas, strict=True)]
    cells = cells.select("key", "shard", "n")
    if not 0 < sum(over) <= LAST:
        return cells
    share = F.array(*(F.lit(float(min(1.0, (4 * o + 1000) / max(1, x)) if o else 0.0)) for o, x in zip(over, loads, strict=True)))
    some: dict[int, list] = {}
    for r in cells.filter(_hash01("key", "shard", F.lit(3)) < share[F.col("shard")]).collect():  # some 4 * LAST + 1,000 * n_shards rows
        some.setdefault(r.shard, []).append((r.key, r.n))
    moves = fitted(some, over, room)
    if not moves:
        return cells
    schema = f"key {cells.schema['key'].dataType.simpleString()}, shard int, n long"
    changed = cells.sparkSession.createDataFrame([x for k, s, t, n in moves for x in ((k, s, -n), (k, t, n))], schema)
    return cells.union(changed).groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0")


def balanced_shards(rows: DataFrame, n_shards: int, id_col: str = "id", key_col: str = "key", max_rounds: int | None = None) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard).

    Row counts of any two shards differ by one at most. Rows with equal key_col
    are neighbours and move to one shard as far as the quotas let them; a null
    key links nothing. Null and repeated ids are allowed: each row gets a slot
    of its own, and equal rows may swap theirs. An empty table gives none; keys
    may be of any length. Columns of rows stay, whatever their names;
    'shard' and 'slot' replace columns of these names.
    """
    kept = rows.drop("shard", "slot")
    base = kept.select(F.struct(*kept.columns).alias("row"), F.col(id_col).alias("id"), F.col(key_col).alias("key"))
    # Written with a number of its own, so that rows equal in everything spread, too.
    base = materialize(base.withColumn("uid", F.monotonically_increasing_id()), "rows")
    total = base.count()
    salts = max(64, -(-total // ROWS_PER_SALT))
    quotas = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    salted = base.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    whole = Window.partitionBy("key")
    blocks = materialize(
        salted.filter("key is not null")
        .groupBy("key", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("of_key", F.sum("n").over(whole))
        .withColumn("before", F.sum("n").over(whole.orderBy("salt")) - F.col("n"))
        .filter("of_key > 1"),
        "blocks",
    )
    linked = base.join(blocks.select("key").distinct(), "key", "left_semi").select("key", "uid")
    packed, start, free = start_cells(linked, quotas)
    cells = materialize(packed.union(settle(propagate(start, free, max_rounds), free)), "dealt")
    spans = (
        cells.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("shard")))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("spans"))
    )
    dealt = blocks.join(spans, "key").select("key", "salt", "before", "spans")
    in_block = Window.partitionBy("key", "salt").orderBy("id", "uid")
    parts = min(MOST_RANK_PARTS, max(RANK_PARTS, max(quotas) // PART_ROWS))
    placed = materialize(
        salted.join(dealt, ["key", "salt"], "left")
        .withColumn("at", F.col("before") + F.row_number().over(in_block) - 1)
        .withColumn("wish", F.coalesce(F.filter("spans", lambda x: x.upto > F.col("at"))[0].shard, F.lit(n_shards)))
        .select("row", "id", "uid", "wish", F.pmod(F.xxhash64("uid", F.lit(17)), F.lit(parts)).alias("part")),
        "placed",
    )
    counts = placed.groupBy("wish", "part").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "wish", "part", (F.sum("n").over(Window.partitionBy("wish").orderBy("part")) - F.col("n")).alias("offset")
    )
    load = {r.wish: r.n for r in counts.groupBy("wish").agg(F.sum("n").alias("n")).collect()}
    kept_n = [min(load.get(s, 0), quotas[s]) for s in range(n_shards)]
    over_at, pooled = [], load.get(n_shards, 0)
    for s in range(n_shards):
        over_at.append(pooled)
        pooled += load.get(s, 0) - kept_n[s]
    gaps, start = [], 0
    for s in range(n_shards):
        gaps.append((start, start + quotas[s] - kept_n[s]))
        start = gaps[-1][1]

    def longs(values) -> F.Column:
        return F.array(*(F.lit(int(v)).cast("long") for v in values))

    limit, pool_base = longs([*kept_n, 0]), longs([*over_at, 0])
    # The offsets have (n_shards + 1) * MOST_RANK_PARTS rows at most.
    ranked = placed.join(F.broadcast(offsets), ["wish", "part"]).withColumn(
        "rank", F.col("offset") + F.row_number().over(Window.partitionBy("wish", "part").orderBy("id", "uid")) - 1
    )
    pool = pool_base[F.col("wish")] + F.col("rank") - limit[F.col("wish")]
    spill = F.filter(
        F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for s, (a, b) in enumerate(gaps))),
        lambda g: (g.a <= F.col("pool")) & (F.col("pool") < g.b),
    )[0]
    stays = F.col("rank") < limit[F.col("wish")]
    out = ranked.withColumn("pool", pool).withColumn("gap", F.when(~stays, spill))
    return out.select(
        "row.*",
        F.when(stays, F.col("wish")).otherwise(F.col("gap.shard")).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(longs(kept_n)[F.col("gap.shard")] + F.col("pool") - F.col("gap.a")).cast("long").alias("slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Law 'rows': shard counts are one apart at most. Documents of equal text are
    linked (null texts with one another); a null text has size 1 and the
    CRC-32 of no bytes, 0. Every row, repeated ones too, is placed once. An
    empty table gives an empty result.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.md5(text)).alias("link"),
    )
    return balanced_shards(rows, n_shards, "doc_id", "link").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
