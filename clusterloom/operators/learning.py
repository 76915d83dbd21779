"""The learning surface around searches: configuration features, masks, heads, budgets, slates and classic predictors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import search

VIEWS = ("x_only", "y_only", "xy_2d")
#: Objective of a failed trial.
FAILURE = -1e12
STRATEGIES: dict[str, Callable] = {"brute_force": search.enumerate_space, "random": search.random_space}


def register_strategy(name: str, run: Callable) -> None:
    """Add a search strategy (UDF-10): a function that gives (candidate, algorithm, config JSON) rows."""
    STRATEGIES[name] = run


def parse_config(text: str) -> dict:
    """A search configuration of the nested or the flat shape, as space, objective, strategy and parameters (OBJ-01)."""
    raw = json.loads(text)
    strategy, params = raw["search_algorithm"], raw.get("search_algorithm_params", {})
    if isinstance(strategy, Mapping):
        strategy, params = strategy["type"], strategy.get("params", {})
    metrics = raw["cvi"].get("metrics", {})
    weights = dict(metrics) if isinstance(metrics, Mapping) else dict.fromkeys(metrics, 1.0)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown search strategy: {strategy!r}")
    return {"space": raw["search_space"], "objective": str(raw["cvi"].get("type", "generic")).lower(), "weights": weights, "objective_params": dict(raw["cvi"].get("params", {})), "strategy": strategy, "params": dict(params), "runtime": dict(raw.get("runtime", {}))}


def candidates_of(config: Mapping) -> list[tuple[int, str, str]]:
    """Candidates of a parsed configuration."""
    space = {a: {p: tuple(v) if isinstance(v, (list, tuple)) else (v,) for p, v in own.items()} for a, own in config["space"].items()}
    return STRATEGIES[config["strategy"]](**config["params"], space=space)


def within_patience(trials: DataFrame, keys: Sequence[str], patience: int, order: str = "candidate", score: str = "objective") -> DataFrame:
    """Trials that a search with patience would have run (OBJ-18): it stops after so many without a better score."""
    up = Window.partitionBy(*keys).orderBy(order)
    value = F.coalesce(score, F.lit(FAILURE))
    before = F.max("_v").over(up.rowsBetween(Window.unboundedPreceding, -1))
    marked = trials.withColumn("_v", value).withColumn("_better", F.coalesce(F.col("_v") > before, F.lit(True)))
    numbered = marked.withColumn("_n", F.row_number().over(up)).withColumn("_last", F.max(F.when(F.col("_better"), F.col("_n"))).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    # The first trial that ends patience is run, those after it are not.
    ended = F.min(F.when(F.col("_n") - F.col("_last") >= patience, F.col("_n"))).over(Window.partitionBy(*keys))
    return numbered.withColumn("_end", ended).filter("_end is null or _n <= _end").drop("_v", "_better", "_n", "_last", "_end")


def replace_constrained(slate: Sequence[tuple[str, Mapping]], spare: Mapping[str, Iterable[Mapping]], constrained: str = "hdbscan_constrained") -> list[tuple[str, Mapping]]:
    """A slate of the same length in which constrained configurations give way to spare ones of the other algorithms, in turns (OBJ-29)."""
    kept = {a for a, _ in slate if not a.startswith(constrained)}
    if not kept and any(a.startswith(constrained) for a, _ in slate):
        raise ValueError("no other algorithm in the slate")
    seen = {(a, json.dumps(c, sort_keys=True)) for a, c in slate}
    queues = [(a, [c for c in spare.get(a, ()) if (a, json.dumps(c, sort_keys=True)) not in seen]) for a in sorted(kept)]
    turn = [(a, own[i]) for i in range(max((len(q) for _, q in queues), default=0)) for a, own in queues if i < len(own)]
    fresh = iter(turn)
    return [next(fresh, (a, c)) if a.startswith(constrained) else (a, c) for a, c in slate]


def config_block(algorithms: Sequence[str], numeric: Sequence[str], flags: Sequence[str] = (), algorithm: str = "algorithm", config: str = "config") -> list[Column]:
    """Columns of a configuration (RNK-02, RNK-03): one-hot algorithm base, target K, each numeric parameter with its mask, and flags."""
    base, own = F.element_at(F.split(algorithm, "-"), 1), F.from_json(config, "map<string,string>")
    target = F.when(F.col(algorithm).contains("-"), F.element_at(F.split(algorithm, "-"), -1).try_cast("double"))
    one = [(base == a).cast("double").alias(f"algo__{a}") for a in algorithms]
    goal = [F.coalesce(target, F.lit(0.0)).alias("cfg__target_k"), target.isNotNull().cast("double").alias("cfgmask__target_k")]
    value = lambda h: F.element_at(own, F.lit(h)).try_cast("double")
    numbers = [x for h in numeric for x in (F.coalesce(value(h), F.lit(0.0)).alias(f"cfg__{h}"), value(h).isNotNull().cast("double").alias(f"cfgmask__{h}"))]
    return [*one, *goal, *numbers, *(F.element_at(own, F.lit(h)).isNotNull().cast("double").alias(f"cfgmask__{h}") for h in flags)]


def online_row(view: str = "view_id", partition: Sequence[str] = (), sources: Sequence[str] = ("mlp", "knn"), k_modes: Sequence[str] = ("top1", "top3", "top5", "top10", "dynamic"), utilities: Sequence[str] = ()) -> list[Column]:
    """The blocks of a trial's feature row beside its configuration and masked values (RNK-01): view, partition, source, K mode, K, utilities."""
    hot = lambda column, values, name: [(F.col(column) == v).cast("double").alias(f"{name}__{v}") for v in values]
    return [*hot(view, VIEWS, "view"), *map(F.col, partition), *hot("source", sources, "source"), *hot("k_mode", k_modes, "k_mode"), F.col("actual_k").cast("double"), *map(F.col, utilities)]


def hidden_values(wide: DataFrame, metrics: Sequence[str], observed: str = "observed") -> DataFrame:
    """(metric_id, n): values of unobserved metrics that a feature table still carries (RNK-05); empty when all is well."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric_id"), (~F.array_contains(observed, m) & (F.coalesce(F.col(f"value__{m}"), F.lit(0.0)) != 0.0)).alias("bad")) for m in metrics))).alias("x")
    return wide.select(cells).filter("x.bad").groupBy("x.metric_id").agg(F.count("*").alias("n"))


def policy_rows(meta: DataFrame, utilities: DataFrame, targets: DataFrame, keys: Sequence[str] = ("dataset_id", "view_id")) -> DataFrame:
    """The policy predictor's training table (RNK-17): a row a dataset and view with features, utilities and each policy's ARI."""
    policies = targets.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("policy_id", "ari")))).alias("ari_by_policy"))
    profile = utilities.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_id", "utility")))).alias("utilities"))
    return meta.join(profile, list(keys)).join(policies, list(keys))


def head_mapping(targets: Sequence[str], groups: Mapping[str, Sequence[str]], prefix: str = "utility__") -> dict[str, list[int]]:
    """Indices of the targets of each head, in the groups' order; metrics without a group go to 'other' (ML-19)."""
    names = [t.removeprefix(prefix) for t in targets]
    owner = {m: g for g, own in groups.items() for m in own}
    heads = {g: [i for i, n in enumerate(names) if owner.get(n) == g] for g in groups} | {"other": [i for i, n in enumerate(names) if n not in owner]}
    return {g: own for g, own in heads.items() if own}


class FrozenPredictor:
    """Utilities of a query vector from a frozen neighbour table, with answers kept by key (ML-13).

    The table is a sample of declared size: it is held in memory.
    """

    def __init__(self, vectors: np.ndarray, utilities: np.ndarray, metrics: Sequence[str], k: int, inverse: bool = True, most: int = 200_000):
        if len(vectors) > most:
            raise ValueError(f"{most} reference vectors at most")
        self.x, self.u, self.metrics, self.k, self.inverse, self.kept = np.asarray(vectors, float), np.asarray(utilities, float), list(metrics), k, inverse, {}

    def predict(self, vector, key=None) -> dict[str, float]:
        if key is None or key not in self.kept:
            d = np.sqrt(((self.x - np.nan_to_num(np.asarray(vector, float))) ** 2).sum(1))
            near = np.lexsort((np.arange(len(d)), d))[: self.k]
            same = d[near] <= 1e-12
            w = same.astype(float) if same.any() and self.inverse else 1 / (d[near] + 1e-12) if self.inverse else np.ones(len(near))
            answer = dict(zip(self.metrics, np.clip(w @ self.u[near] / w.sum(), 0, 1).tolist(), strict=True))
            if key is None:
                return answer
            self.kept[key] = answer
        return self.kept[key]


def fit_ari_network(train: DataFrame, columns: Sequence[str], target: str = "ari", hidden: Sequence[int] = (60, 30, 10), epochs: int = 200, patience: int = 10, rate: float = 1e-3, seed: int = 0, most: int = 200_000) -> Callable[[DataFrame], DataFrame]:
    """A regression network from index vectors to ARI (BL-03): medians for missing values, standardised, early stopping on a tenth.

    Training reads `most` rows at most, lowest hash first; prediction is a map.
    """
    taken = train.select(*columns, target).filter(F.col(target).isNotNull()).orderBy(F.xxhash64(*columns, target)).limit(most).toPandas()
    x, y = taken[list(columns)].to_numpy(float), taken[target].to_numpy(float)
    x[~np.isfinite(x)] = np.nan
    with np.errstate(all="ignore"):
        middle = np.nan_to_num(np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in x.T]))
    x = np.where(np.isnan(x), middle, x)
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1)
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    sizes = [z.shape[1], *hidden, 1]
    net = [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:], strict=False)]

    def forward(v):
        layers = [v]
        for i, (w, b) in enumerate(net):
            v = v @ w + b
            layers.append(np.maximum(v, 0) if i < len(net) - 1 else v)
            v = layers[-1]
        return layers

    order = rng.permutation(len(z))
    held, own = order[: len(z) // 10], order[len(z) // 10 :]
    moments, step, best, wait = [[np.zeros_like(p), np.zeros_like(p)] for layer in net for p in layer], 0, (np.inf, None), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
            layers = forward(z[part])
            grad, step = 2 * (layers[-1] - y[part, None]) / max(1, len(part)), step + 1
            for i in range(len(net) - 1, -1, -1):
                updates = layers[i].T @ grad, grad.sum(0)
                grad = (grad @ net[i][0].T) * (layers[i] > 0)
                for j, g in enumerate(updates):
                    m = moments[2 * i + j]
                    m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                    net[i][j] = net[i][j] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        test = held if len(held) else own
        loss = float(((forward(z[test])[-1][:, 0] - y[test]) ** 2).mean()) if len(test) else 0.0
        best, wait = ((loss, [[p.copy() for p in layer] for layer in net]), 0) if loss < best[0] - 1e-5 else (best, wait + 1)
        if wait >= patience:
            break
    net[:] = best[1] or net

    @F.pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        v = np.column_stack([p.to_numpy(float) for p in parts])
        v = np.where(np.isfinite(v), v, middle)
        return pd.Series(forward((v - mean) / scale)[-1][:, 0])

    return lambda rows: rows.withColumn("predicted_ari", run(*(F.col(c).cast("double") for c in columns)))


def fit_index_classifier(train: DataFrame, columns: Sequence[str], label: str, trees: int = 100, seed: int = 0):
    """A random forest from meta-features to the best index (BL-05); missing values count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    clean = lambda df: df.withColumns({f"_f_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})
    names = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    stages = [VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed), IndexToString(inputCol="prediction", outputCol=f"predicted_{label}", labels=names.labels)]
    model = Pipeline(stages=stages).fit(names.transform(clean(train)))
    extra = ["_x", "rawPrediction", "probability", "prediction", *(f"_f_{c}" for c in columns)]
    return lambda rows: model.transform(clean(rows)).drop(*extra)


def landmark_scores(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Indices of a mean-shift partition of each cloud (BL-06): keys, n_clusters, silhouette, calinski_harabasz, davies_bouldin."""
    from . import indices

    labelled = written(search.labels_of(points, "mean_shift", {}, keys), "labels")  # several passes read it
    own = list(keys)
    out = labelled.groupBy(*own).agg(F.countDistinct("label").alias("n_clusters"))
    for name, f in (("silhouette", indices.silhouette), ("calinski_harabasz", indices.calinski_harabasz), ("davies_bouldin", indices.davies_bouldin)):
        out = out.join(f(labelled, own).select(*own, F.col("raw").alias(name)), own, "left")
    return out


def candidate_trace(log: DataFrame, arms: Mapping[str, Callable[[DataFrame], Column]], keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """(keys, arm, candidate): every arm chooses from one shared trace of valid trials by its own score, ties to the lowest candidate (BL-08, BL-09)."""
    own = log.filter("valid")
    out = None
    for name, score in sorted(arms.items()):
        order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_s"), "candidate")
        part = own.withColumn("_s", score(own)).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*keys, F.lit(name).alias("arm"), "candidate")
        out = part if out is None else out.union(part)
    return out


def cloud_structure(points: DataFrame, keys: Sequence[str], label: str = "y_true") -> DataFrame:
    """(keys, label, n, share, centre, deviation, box) of each cluster: the structure of a dataset (GEN-13)."""
    per = points.groupBy(*keys, label).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
