"""Exact resampling in parallel: multinomial bootstraps over units, and permutations of labels.

Units lie in buckets. How many of a draw's picks fall into a bucket follows
from binomials (for labels: hypergeometrics) split down a tree of bucket ranges
whose random numbers hang on the seed, the key and the range alone; every task
walks its own path and gets what the others leave it, so picks always sum to
the number of units and no task sees another's rows. Draws are arrays: a bucket
gives one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of a bucket, picks that a step holds, and buckets that are summed at once.
UNITS, STEP, FAN = 1 << 14, 1 << 22, 64


def key_code(key: Sequence) -> int:
    return zlib.crc32(repr([None if k is None else str(k) for k in key]).encode())


def picks_of(bucket: int, sizes: np.ndarray, draws: int, seed: Sequence[int]) -> np.ndarray:
    """How many of sum(sizes) picks with replacement fall into the bucket, for each draw."""
    low, high, n = 0, len(sizes), np.full(draws, sizes.sum(), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, total = sizes[low:middle].sum(), sizes[low:high].sum()
        k = np.random.default_rng([*seed, low, high]).binomial(n, left / total) if total else np.zeros(draws, np.int64)
        low, high, n = (low, middle, k) if bucket < middle else (middle, high, n - k)
    return n


def labels_of(bucket: int, sizes: np.ndarray, groups: np.ndarray, draws: int, seed: Sequence[int]) -> np.ndarray:
    """(draws, groups): labels of each group that fall into the bucket when all labels are dealt anew."""
    low, high, left = 0, len(sizes), np.tile(groups, (draws, 1))
    while high - low > 1:
        middle = (low + high) // 2
        first, rng = int(sizes[low:middle].sum()), np.random.default_rng([*seed, low, high])
        taken = np.array([rng.multivariate_hypergeometric(row, first, method="marginals") for row in left])
        low, high, left = (low, middle, taken) if bucket < middle else (middle, high, left - taken)
    return left


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in names)


def _bucketed(rows: DataFrame, keys: list[str], unit: str, weight: str) -> DataFrame:
    """rows with their bucket, those of one unit in the same, and a row a bucket with the list of the key's bucket sizes, all else of it NULL."""
    units = rows.groupBy(*keys, unit).agg(F.max(weight).alias("_w"))
    many = units.groupBy(*keys).agg(F.ceil(F.count("*") / UNITS).alias("_buckets"))
    bucket = F.pmod(F.xxhash64(unit), F.col("_buckets")).alias("bucket")
    sizes = _met(units, many, keys).select(*keys, bucket, "_w").groupBy(*keys, "bucket").agg(F.sum("_w").alias("n"))
    listed = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("sizes"))  # units / UNITS entries
    heads = listed.select(*keys, F.explode("sizes.bucket").alias("bucket"), "sizes")
    return _met(rows, many, keys).withColumn("bucket", bucket).drop("_buckets").unionByName(heads, allowMissingColumns=True)


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, NULL meets NULL; b has one row where there is no key."""
    if not keys:
        return a.crossJoin(b)
    renamed = b.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return a.join(renamed, same).drop(*(f"_key{i}" for i in range(len(keys))))


def _place(rows: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray]:
    """(rows of units, position of the bucket among those with units, sizes of these)."""
    head = rows["sizes"].notna()
    listed = rows.loc[head, "sizes"].iloc[0]
    return rows[~head], [s["bucket"] for s in listed].index(rows["bucket"].iloc[0]), np.array([s["n"] for s in listed], np.int64)


def _summed(parts: DataFrame, keys: list[str], arrays: Sequence[str]) -> DataFrame:
    """One row a key: sums of arrays of doubles, FAN buckets at a time, then those."""
    ddl = _kinds(parts, keys) + ", ".join(f"{a} binary" for a in arrays)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = {a: [np.sum([np.frombuffer(x, "<f8") for x in rows.sort_values("bucket")[a]], axis=0).tobytes()] for a in arrays}
        return pd.DataFrame({**{k: rows[k].iloc[:1].tolist() for k in keys}, **total, **({"bucket": rows["fan"].iloc[:1].tolist()} if "fan" in rows else {})})

    fanned = parts.withColumn("fan", F.floor(F.col("bucket") / FAN)).groupBy(*keys, "fan").applyInPandas(add, ddl + ", bucket long")
    return fanned.groupBy(*(keys or [F.lit(1).alias("_one")])).applyInPandas(add, ddl)


def resampled_sums(values: DataFrame, keys: Sequence[str], value: str, unit: str, draws: int, seed: int, series: str | None = None) -> DataFrame:
    """(keys, series, sums binary, counts binary): for each draw the sum and number of the picked units' values.

    A draw picks as many units of a key as there are, with replacement; all rows
    of a unit come with it. Series of a key share the picks. NULL values are left out.
    """
    names, of = list(keys), [series] if series else []
    whole = values.filter(F.col(value).isNotNull()).groupBy(*names, unit, *of).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count("*").alias("_c"))
    rows = _bucketed(whole.withColumn("_one", F.lit(1)), names, unit, "_one").select(*names, *of, F.col(unit).alias("_unit"), "_s", "_c", "bucket", "sizes")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        key = [own[k].iloc[0] for k in names]
        own, place, sizes = _place(own)
        codes, found = pd.factorize(own["_unit"].astype(str), sort=True)
        columns, labels = pd.factorize(own[series], sort=True, use_na_sentinel=False) if series else (np.zeros(len(own), int), [None])
        m, base = len(found), [seed & 0xFFFFFFFF, key_code(key)]
        sums, counts = np.zeros((m, len(labels))), np.zeros((m, len(labels)))
        sums[codes, columns], counts[codes, columns] = own["_s"], own["_c"]
        picks, rng = picks_of(place, sizes, draws, base), np.random.default_rng([*base, place, len(sizes), 1])
        total = np.zeros((2, draws, len(labels)))
        step = max(1, STEP // max(m, 1))
        for a in range(0, draws, step):
            n = picks[a : a + step]
            at = np.repeat(np.arange(len(n)), n) * m + rng.integers(0, m, n.sum())
            times = np.bincount(at, minlength=len(n) * m).reshape(len(n), m)
            total[:, a : a + step] = times @ sums, times @ counts
        out = {"bucket": place, "sums": [s.tobytes() for s in total[0].T.copy()], "counts": [c.tobytes() for c in total[1].T.copy()]}
        return pd.DataFrame({**{k: [v] * len(labels) for k, v in zip(names, key, strict=True)}, **({series: labels} if series else {}), **out})

    ddl = _kinds(values, [*names, *of]) + "bucket long, sums binary, counts binary"
    return _summed(rows.groupBy(*names, "bucket").applyInPandas(run, ddl), [*names, *of], ("sums", "counts"))


def bootstrap(values: DataFrame, keys: Sequence[str], value: str, unit: str, draws: int = 2000, confidence: float = 0.95, seed: int = 1234) -> DataFrame:
    """(keys, low, high): percentile interval of the mean by a multinomial bootstrap over units (ST-01, ST-02, ST-08).

    The protocol takes 10,000 draws for ST-01 and ST-02, 2,000 for ST-08.
    Quantiles are interpolated between order statistics.
    """
    names, tail = list(keys), (1 - confidence) / 2

    def ends(batches):
        for b in batches:
            out = []
            for s, c in zip(b["sums"], b["counts"], strict=True):
                s, c = np.frombuffer(s, "<f8"), np.frombuffer(c, "<f8")
                means = s[c > 0] / c[c > 0]
                out.append(np.quantile(means, [tail, 1 - tail]) if len(means) else [None, None])
            yield b[names].assign(low=[o[0] for o in out], high=[o[1] for o in out])

    sums = resampled_sums(values, names, value, unit, draws, seed)
    return sums.mapInPandas(ends, _kinds(values, names) + "low double, high double")


def winners(values: DataFrame, keys: Sequence[str], series: str, value: str, unit: str, draws: int = 1000, seed: int = 1234) -> DataFrame:
    """(keys, series, wins, win_share): how often each series has the largest resampled mean, ties to the smaller name (ST-12)."""
    names = list(keys)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(series)
        s, c = (np.array([np.frombuffer(x, "<f8") for x in rows[k]]) for k in ("sums", "counts"))
        means = np.divide(s, c, out=np.full_like(s, -np.inf), where=c > 0)
        wins = np.bincount(means.argmax(0)[np.isfinite(means.max(0))], minlength=len(rows))
        return rows[[*names, series]].assign(wins=wins, win_share=wins / draws)[wins > 0]

    sums = resampled_sums(values, names, value, unit, draws, seed, series)
    return sums.groupBy(*(names or [F.lit(1).alias("_one")])).applyInPandas(count, _kinds(values, [*names, series]) + "wins long, win_share double")


def permutation(values: DataFrame, group: str, value: str, draws: int = 200, seed: int = 7, within: Sequence[str] = ()) -> DataFrame:
    """One row: variance between groups, and the share of label permutations that reach it (ST-22).

    Labels are dealt anew over all rows, or within each combination of the
    columns of within; group sizes stay. Rows without group or value are left
    out. Equal values are one entry with a count, so that a value that half of
    the rows hold costs no more than another.
    """
    names = list(within)
    own = values.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(*names, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    sizes = own.groupBy(*names, "_g").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    overall = own.agg(F.count("*").alias("n"), F.avg("_v").alias("m")).first()
    if not overall.n:
        return values.sparkSession.createDataFrame([], "between double, p_value double")
    n_all, mean = overall.n, overall.m
    seen = sizes.agg(F.sum(F.col("_n") * F.pow(F.col("_s") / F.col("_n") - F.lit(mean), 2)).alias("b"))
    groups = sizes.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_g", "_n"))).alias("groups"))
    entries = own.groupBy(*names, "_v").agg(F.count("*").alias("_times"))
    rows = _bucketed(entries, names, "_v", "_times")
    # The groups of a key travel with the bucket's list of sizes.
    rows = rows.filter("sizes is null").withColumn("groups", F.lit(None).cast(groups.schema["groups"].dataType)).unionByName(_met(rows.filter("sizes is not null"), groups, names))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        key, n = [part[k].iloc[0] for k in names], np.array([g["_n"] for g in part["groups"].dropna().iloc[0]], np.int64)
        part, place, listed = _place(part)
        part = part.sort_values("_v")
        base = [seed & 0xFFFFFFFF, key_code(key)]
        dealt, rng = labels_of(place, listed, n, draws, base), np.random.default_rng([*base, place, len(listed), 1])
        v, times = part["_v"].to_numpy(float), part["_times"].to_numpy(np.int64)
        often = times > 64  # dealt at once; the others one by one
        single = np.repeat(v[~often], times[~often])
        sums = np.zeros((draws, len(n)))
        for d in range(draws):
            left = dealt[d].copy()
            for x, t in zip(v[often], times[often], strict=True):
                got = rng.multivariate_hypergeometric(left, int(t), method="marginals")
                sums[d] += x * got
                left -= got
            sums[d] += np.bincount(rng.permutation(np.repeat(np.arange(len(n)), left)), single, len(n))
        return pd.DataFrame({**{k: [x] for k, x in zip(names, key, strict=True)}, "bucket": [place], "sums": [sums.tobytes()], "sizes": [n.astype("<f8").tobytes()]})

    parts = rows.groupBy(*names, "bucket").applyInPandas(run, _kinds(values, names) + "bucket long, sums binary, sizes binary")
    # The sizes are the same in each bucket of a key: their sum is divided by that of ones.
    summed = _summed(parts.withColumn("ones", F.lit(np.ones(1).tobytes())), names, ("sums", "sizes", "ones"))

    def between(batches):
        for b in batches:
            for s, n, one in zip(b["sums"], b["sizes"], b["ones"], strict=True):
                n = np.frombuffer(n, "<f8") / np.frombuffer(one, "<f8")
                s = np.frombuffer(s, "<f8").reshape(draws, len(n))
                yield pd.DataFrame({"draw": np.arange(draws), "b": (n * (s / n - mean) ** 2).sum(1)})

    drawn = summed.mapInPandas(between, "draw int, b double").groupBy("draw").agg(F.sum("b").alias("b"))
    counted = drawn.crossJoin(F.broadcast(seen.withColumnRenamed("b", "seen"))).groupBy("seen").agg(F.count_if(F.col("b") / n_all >= F.col("seen") / n_all - 1e-12).alias("reached"))
    return counted.select((F.col("seen") / n_all).alias("between"), ((1 + F.col("reached")) / (1 + draws)).alias("p_value"))
