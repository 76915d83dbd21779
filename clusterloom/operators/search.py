"""Search spaces, trials and the pipeline that clusters a dataset without labels."""

from __future__ import annotations

import json
import os
import pickle
import select
import signal
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import indices, kernels, tiles

# The search space of the x_only view.
K_RANGE = (2, 3, 4, 5)
SPACE = {
    "kmeans": {"n_clusters": K_RANGE},
    "minibatch_kmeans": {"n_clusters": K_RANGE, "batch_size": (100, 256)},
    "gmm": {"n_components": K_RANGE, "covariance_type": ("full", "diag")},
    "agglomerative": {"n_clusters": K_RANGE, "linkage": ("ward", "average", "complete")},
    "birch": {"n_clusters": K_RANGE, "threshold": (0.05, 0.1, 0.2, 0.35), "branching_factor": (25, 50)},
    "dbscan": {"eps": (0.03, 0.05, 0.08, 0.12, 0.2), "min_samples": (3, 5, 10)},
    "hdbscan": {"min_cluster_size": (10, 25, 50, 100), "min_samples": (3, 5, 10)},
    "optics": {"min_samples": (3, 5, 10), "xi": (0.03, 0.05, 0.1), "min_cluster_size": (0.02, 0.05, 0.1)},
    **{f"hdbscan_constrained-{n}": {} for n in K_RANGE},
}


@dataclass(frozen=True)
class Index:
    """An index that searches can maximise (OBJ-02, UDF-07): a kernel of points and labels, its squash to [0, 1], its direction."""

    kernel: Callable
    squash: Callable[[float], float] = float
    higher_is_better: bool = True

    def normalised(self, raw: float | None) -> float:
        """0 for a failed index; 1 minus the squash where lower is better."""
        if raw is None or not np.isfinite(raw):
            return 0.0
        value = float(np.clip(self.squash(raw), 0.0, 1.0))
        return value if self.higher_is_better else 1.0 - value


METRICS = {
    "silhouette": Index(indices.silhouette_kernel, lambda v: (v + 1) / 2),
    "neighborhood_purity": Index(indices.purity_kernel),
    "min_intercluster_distance": Index(indices.min_distance_kernel, lambda v: 1 - np.exp(-max(0.0, v))),
}
#: Configurations that a task runs on one copy of a cloud, and those of a candidate table at most (a few hundred bytes each).
CHUNK, MOST_CANDIDATES = 16, 100_000
#: Points of a cloud whose trials one task runs and measures; of larger ones a task runs LARGE_CHUNK and takes the silhouettes of PART points.
TASK_POINTS, LARGE_CHUNK, PART = 8_192, 4, 8_192
#: Points of a cloud whose distances one task holds for hdbscan.
HDBSCAN_POINTS = 10_000


def register_index(name: str, kernel: Callable, squash: Callable[[float], float] = float, higher_is_better: bool = True) -> None:
    """Add a user's index (UDF-07): trials, objectives and searches take it by name from then on."""
    METRICS[name] = Index(kernel, squash, higher_is_better)


def enumerate_space(space: dict = SPACE) -> list[tuple[int, str, str]]:
    """(candidate, algorithm, config JSON): the Cartesian product, in a fixed order (OBJ-13, OBJ-16, OBJ-28)."""
    out = []
    for name in sorted(space):
        names = sorted(space[name])
        for values in product(*(space[name][p] for p in names)):
            out.append((len(out) + 1, name, json.dumps(dict(zip(names, values, strict=True)), sort_keys=True)))
    return out


def random_space(n: int, seed: int, space: dict = SPACE) -> list[tuple[int, str, str]]:
    """n configurations drawn uniformly: an algorithm, then each parameter (OBJ-14)."""
    rng, names = np.random.default_rng(seed), sorted(space)
    out = []
    for i in range(1, n + 1):
        name = names[rng.integers(len(names))]
        config = {p: v[rng.integers(len(v))] for p, v in sorted(space[name].items())}
        out.append((i, name, json.dumps(config, sort_keys=True)))
    return out


def candidate_table(spark: SparkSession, rows: Sequence[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "candidate int, algorithm string, config string")


def normalised(metric: str, raw: float | None) -> float:
    """The index's squash to [0, 1], 0 for a failed index (OBJ-02)."""
    return METRICS[metric].normalised(raw)


class ChildError(Exception):
    """What a child process raised, in words."""


def within(seconds: float | None, run: Callable):
    """run(), in a child process that is ended after so many seconds (UDF-05); a TimeoutError tells of it."""
    if seconds is None:
        return run()
    read, write = os.pipe()
    child = os.fork()
    if not child:
        try:
            try:
                told = pickle.dumps((run(), None))
            except Exception as e:  # the parent raises it
                told = pickle.dumps((None, f"{type(e).__name__}: {e}"))
            with os.fdopen(write, "wb") as out:
                out.write(told)
        finally:
            os._exit(0)
    os.close(write)
    parts, until = [], time.monotonic() + seconds
    try:
        while select.select([read], [], [], max(0.0, until - time.monotonic()))[0]:
            part = os.read(read, 1 << 20)
            if not part:
                break
            parts.append(part)
        else:
            raise TimeoutError(f"no labels after {seconds:g} s")
    finally:
        os.close(read)
        os.kill(child, signal.SIGKILL)
        os.waitpid(child, 0)
    labels, error = pickle.loads(b"".join(parts)) if parts else (None, "the child process died")
    if error:
        raise ChildError(error)
    return labels


def _safe(kernel: Callable, x: np.ndarray, labels: np.ndarray) -> float | None:
    """An index, None where it fails."""
    try:
        return kernel(x, labels)
    except (ValueError, ArithmeticError, np.linalg.LinAlgError):
        return None


def evaluator(metrics: Sequence[str], algorithms: Sequence[str] = (), seconds: float | None = None) -> Callable:
    """A function of points, algorithm and parameters that clusters and takes the indices; failures become results (OBJ-03, OBJ-19).

    It carries the registered indices and algorithms of this process, so that
    tasks know those that a user has added.
    """
    chosen, known = {m: METRICS[m] for m in metrics}, dict(kernels.ALGORITHMS)
    by_pass = [m for m, i in chosen.items() if i.kernel is indices.silhouette_kernel]  # indices of all distances

    def run(x: np.ndarray, name: str, config: dict) -> dict:
        return several(x, [(name, config)])[0]

    def several(x: np.ndarray, trials: Sequence[tuple[str, dict]]) -> list[dict]:
        """Trials of one cloud: what they have in common is done once."""
        found = labelled(x, trials)
        wide = iter(indices.silhouettes(x, [labels for labels, _, valid in found if valid]) if by_pass and np.isfinite(x).all() else [])
        return [result(x, *f, dict.fromkeys(by_pass, next(wide, None)) if f[2] else {}) for f in found]

    def labelled(x: np.ndarray, trials: Sequence[tuple[str, dict]]) -> list[tuple[np.ndarray, str | None, bool]]:
        with kernels.shared():
            return [partition(x, name, config) for name, config in trials]

    def result(x: np.ndarray, labels: np.ndarray, error: str | None, valid: bool, known: dict, later: Sequence[str] = ()) -> dict:
        """What a trial's log tells, but for the indices named in later."""
        inside = labels >= 0
        raws = {m: None if m in later or not valid else known[m] if known.get(m) is not None else _safe(i.kernel, x[inside], labels[inside]) for m, i in chosen.items()}
        norms = {m: i.normalised(raws[m]) for m, i in chosen.items()}
        return {"valid": valid, "n_clusters": len(np.unique(labels[inside])), "noise_ratio": float((~inside).mean()) if len(x) else 0.0, "exception": error, "raws": raws, "norms": norms}

    def partition(x: np.ndarray, name: str, config: dict) -> tuple[np.ndarray, str | None, bool]:
        error = None
        try:
            kernel, fixed = kernels.resolve(name, known)
            labels = np.asarray(within(seconds, lambda: np.asarray(kernel(x, **config, **fixed))))
        except ChildError as e:
            labels, error = np.full(len(x), -1), str(e)
        except Exception as e:  # a failed trial is a result, too
            labels, error = np.full(len(x), -1), f"{type(e).__name__}: {e}"
        return labels, error, bool(len(np.unique(labels[labels >= 0])) >= 2 and error is None)

    run.several, run.labelled, run.result, run.by_pass, run.chosen = several, labelled, result, by_pass, chosen
    return run


def spread(points: DataFrame, *by: str) -> DataFrame:
    """points dealt out by columns to as many tasks as shuffles have: work on a cloud doesn't follow its bytes, by which small ones would share a task."""
    return points.repartition(max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.sparkSession.sparkContext.defaultParallelism), *by)


def log_ddl(points: DataFrame, names: Sequence[str]) -> str:
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in names)
    return f"{kinds}, candidate int, algorithm string, config string, valid boolean, n_clusters int, noise_ratio double, exception string, metric_id string, raw double, norm double"


def run_trials(points: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("dataset_id",), metrics: Sequence[str] = tuple(METRICS), seconds: float | None = None) -> DataFrame:
    """Trial log, long: keys, candidate, algorithm, config, labels statistics, exception, metric, raw, norm (OBJ-03, OBJ-19, CLU-14, SRC-25).

    A task holds one cloud and CHUNK configurations, so a cloud is copied once
    a chunk; clouds of more than TASK_POINTS are shared by more tasks. Failures, and trials beyond the given seconds, become rows. More
    than MOST_CANDIDATES configurations are refused.
    """
    names = list(keys)
    given = sorted((r.candidate, r.algorithm, r.config) for r in candidates.select("candidate", "algorithm", "config").limit(MOST_CANDIDATES + 1).collect())
    if len(given) > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} configurations")
    # Equal configurations are run once; those of one algorithm lie together, as they share work.
    distinct = sorted({(a, c) for _, a, c in given}, key=lambda t: (t[0].partition("-")[0], t))
    evaluate = evaluator(metrics, tuple({a for _, a, _ in given}), seconds)
    ddl = log_ddl(points, names)

    def logged(key: dict, own: dict) -> pd.DataFrame:
        """Log rows of the given configurations that own has the results of."""
        out = []
        for candidate, name, config in given:
            if (found := own.get((name, config))) is None:
                continue
            base = {**key, "candidate": candidate, "algorithm": name, "config": config, **{c: found[c] for c in ("valid", "n_clusters", "noise_ratio", "exception")}}
            out += [{**base, "metric_id": m, "raw": found["raws"][m], "norm": found["norms"][m]} for m in metrics]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    small, large = indices.split_large(points.select(*names, "point_id", "x", "y"), names, TASK_POINTS)
    dealt = _dealt(distinct, -(-len(given) // CHUNK))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        x, own = rows[["x", "y"]].to_numpy(float), dealt[int(rows["_chunk"].iloc[0])]
        return logged({c: rows[c].iloc[0] for c in names}, dict(zip(own, evaluate.several(x, [(name, json.loads(config)) for name, config in own]), strict=True)))

    out = _copied(small, names, len(dealt)).groupBy(*names, "_chunk").applyInPandas(run, ddl)
    return out if large is None else out.unionByName(_large_trials(large, names, distinct, evaluate, logged, ddl))


def _dealt(trials: Sequence, chunks: int) -> list:
    chunks = max(1, chunks)
    return [trials[i * len(trials) // chunks : (i + 1) * len(trials) // chunks] for i in range(chunks)]


def _copied(points: DataFrame, names: Sequence[str], chunks: int) -> DataFrame:
    """A copy of each cloud a chunk."""
    return spread(points.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))), *names, "_chunk")


def _large_trials(points: DataFrame, names: list[str], distinct: Sequence[tuple[str, str]], evaluate: Callable, logged: Callable, ddl: str) -> DataFrame:
    """The log of clouds whose trials are dealt to more tasks: labels first, then silhouettes, a part of the points a task."""
    dealt, kinds = _dealt(distinct, -(-len(distinct) // LARGE_CHUNK)), "".join(f"{c} {points.schema[c].dataType.simpleString()}, " for c in names)
    place = {t: i for i, t in enumerate(distinct)}

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        x, chunk, out = rows[["x", "y"]].to_numpy(float), int(rows["_chunk"].iloc[0]), []
        later = evaluate.by_pass if np.isfinite(x).all() else []
        for i, (trial, found) in enumerate(zip(dealt[chunk], evaluate.labelled(x, [(name, json.loads(config)) for name, config in dealt[chunk]]), strict=True)):
            facts = json.dumps(evaluate.result(x, *found, {}, later), default=float)
            asked = found[0].astype("<i4").tobytes() if later and found[2] else None
            first = chunk == 0 and i == 0 and later  # the cloud itself travels with one of its trials
            out.append({**{c: rows[c].iloc[0] for c in names}, "trial": place[trial], "n": len(x) if later else 0, "facts": facts, "labels": asked, "xy": x.astype("<f8").tobytes() if first else None})
        return pd.DataFrame(out)

    tried = written(_copied(points, names, len(dealt)).groupBy(*names, "_chunk").applyInPandas(label, kinds + "trial int, n long, facts string, labels binary, xy binary"), "trials")

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        part, key = int(rows["part"].iloc[0]), {c: rows[c].iloc[0] for c in names}
        x = np.frombuffer(next(v for v in rows["xy"] if v is not None), "<f8").reshape(-1, 2)
        rows = rows[rows["labels"].notna()].sort_values("trial")
        found = indices.silhouette_sums(x, [np.frombuffer(v, "<i4") for v in rows["labels"]], part * PART, min(len(x), (part + 1) * PART))
        return pd.DataFrame({**{c: [v] * len(rows) for c, v in key.items()}, "trial": rows["trial"].to_numpy(), "part": part, "total": [t for t, _ in found], "n": [n for _, n in found]})

    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PART).cast("int") - 1)).alias("part")
    asked = tried.filter("n > 0 and (labels is not null or xy is not null)").select(*names, "trial", "labels", "xy", parts)
    sums = spread(asked, *names, "part").groupBy(*names, "part").applyInPandas(measure, kinds + "trial int, part int, total double, n long")
    sums = sums.select(*names, "trial", "part", "total", "n", F.lit(None).cast("string").alias("facts"))

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows, own = rows.sort_values(["trial", "part"]), {}
        for trial, mine in rows.groupby("trial"):
            facts, told = json.loads(mine["facts"].dropna().iloc[0]), mine[mine["facts"].isna()]
            if told["n"].sum() > 0:
                for m in evaluate.by_pass:
                    facts["raws"][m] = float(told["total"].sum() / told["n"].sum())
                    facts["norms"][m] = evaluate.chosen[m].normalised(facts["raws"][m])
            own[distinct[int(trial)]] = facts
        return logged({c: rows[c].iloc[0] for c in names}, own)

    told = tried.select(*names, "trial", F.lit(-1).alias("part"), F.lit(0.0).alias("total"), "n", "facts").unionByName(sums)
    return told.groupBy(*(names or [F.lit(1).alias("_one")])).applyInPandas(finish, ddl)


def best_trials(log: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The objective's maximiser per dataset: mean normalised value, ties to the lowest candidate (OBJ-31, WIN-13)."""
    scored = log.filter("valid").groupBy(*keys, "candidate", "algorithm", "config").agg(F.round(F.avg("norm"), 9).alias("objective"), F.max("n_clusters").alias("n_clusters"))
    pick = F.max(F.struct("objective", (-F.col("candidate")).alias("_at"), "candidate", "algorithm", "config", "n_clusters")).alias("b")
    return scored.groupBy(*keys).agg(pick).select(*keys, "b.candidate", "b.algorithm", "b.config", "b.objective", "b.n_clusters")


def best_per_algorithm(log: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The best configuration of each algorithm (OBJ-20)."""
    scored = log.filter("valid").groupBy(*keys, "algorithm", "candidate").agg(F.round(F.avg("norm"), 9).alias("objective"))
    pick = F.max(F.struct("objective", (-F.col("candidate")).alias("_at"), "candidate")).alias("b")
    return scored.groupBy(*keys, "algorithm").agg(pick).select(*keys, "algorithm", "b.candidate", "b.objective")


def labels_of(points: DataFrame, algorithm: str, config: dict, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """points with 'label' from one algorithm. Clouds beyond HDBSCAN_POINTS are clustered by hdbscan in tiles."""
    names, known = list(keys), dict(kernels.ALGORITHMS)
    if algorithm == "hdbscan":
        points, large = indices.split_large(points, names, HDBSCAN_POINTS)
        if large is not None:
            labels = tiles.hdbscan(large, names, **config)
            many = large.select(*names, "point_id", "x", "y").join(labels, [*names, "point_id"])
            kinds = [F.col(c).cast(points.schema[c].dataType) for c in [*names, "point_id"]]
            return labels_of(points, algorithm, config, keys).union(many.select(*kinds, F.col("x").cast("double"), F.col("y").cast("double"), "label")) if names else many.select(*kinds, "x", "y", "label")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        kernel, fixed = kernels.resolve(algorithm, known)
        return rows.assign(label=np.asarray(kernel(rows[["x", "y"]].to_numpy(float), **config, **fixed)).astype("int32"))[[*names, "point_id", "x", "y", "label"]]

    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in [*names, "point_id"])
    return points.select(*names, "point_id", "x", "y").groupBy(*names).applyInPandas(run, f"{kinds}, x double, y double, label int")


def cluster(points: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The chosen trial of each dataset: search, score, select (OBJ-30)."""
    return best_trials(run_trials(points, candidates, keys), keys)
