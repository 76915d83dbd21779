"""Learned predictors: utility profiles by a small network, candidate rerankers and policy selectors.

Training rows are a row per dataset and view; they are bounded by the number
of datasets, are collected once and fitted in NumPy. Predictions run in Arrow
batches. Gradient boosting uses the JVM's own trees.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import boosting

#: Training rows that one fit may collect.
MAX_TRAINING = 200_000


class UtilityNet:
    """Shared layer and a sigmoid head per group of targets (ML-14 to ML-17).

    The loss is the weighted squared error plus a pairwise ranking term; Adam
    with early stopping on a held-out tenth.
    """

    def __init__(self, heads: Sequence[Sequence[int]], hidden: int = 64, head_hidden: int = 16, rate: float = 3e-3, epochs: int = 300, patience: int = 30, rank_weight: float = 0.2, seed: int = 0):
        self.heads, self.hidden, self.head_hidden = [list(h) for h in heads], hidden, head_hidden
        self.rate, self.epochs, self.patience, self.rank_weight, self.seed = rate, epochs, patience, rank_weight, seed

    def _start(self, d: int, rng) -> dict[str, np.ndarray]:
        p = {"w": rng.normal(0, d**-0.5, (d, self.hidden)), "b": np.zeros(self.hidden)}
        for i, h in enumerate(self.heads):
            p |= {f"w{i}": rng.normal(0, self.hidden**-0.5, (self.hidden, self.head_hidden)), f"b{i}": np.zeros(self.head_hidden), f"v{i}": rng.normal(0, self.head_hidden**-0.5, (self.head_hidden, len(h))), f"c{i}": np.zeros(len(h))}
        return p

    def _forward(self, p, x: np.ndarray):
        a = np.maximum(x @ p["w"] + p["b"], 0)
        mid = [np.maximum(a @ p[f"w{i}"] + p[f"b{i}"], 0) for i in range(len(self.heads))]
        y = np.zeros((len(x), sum(map(len, self.heads))))
        for i, h in enumerate(self.heads):
            y[:, h] = 1 / (1 + np.exp(-(mid[i] @ p[f"v{i}"] + p[f"c{i}"])))
        return a, mid, y

    def _slope(self, y: np.ndarray, t: np.ndarray) -> np.ndarray:
        g = 2 * (y - t) / t.size
        if self.rank_weight and t.shape[1] > 1:
            want = np.sign(t[:, :, None] - t[:, None, :])
            push = -want / (1 + np.exp(np.clip(want * (y[:, :, None] - y[:, None, :]), -30, 30)))
            g += self.rank_weight * push.sum(2) / (t.size * t.shape[1])
        return g

    def fit(self, x: np.ndarray, t: np.ndarray) -> UtilityNet:
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(x))
        held = order[: max(1, len(x) // 10)] if len(x) > 10 else order
        own = order[len(held) :] if len(x) > 10 else order
        p = self._start(x.shape[1], rng)
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        best, self.parts, waited, step = np.inf, {k: a.copy() for k, a in p.items()}, 0, 0
        for _ in range(self.epochs):
            for batch in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
                a, mid, y = self._forward(p, x[batch])
                dy = self._slope(y, t[batch]) * y * (1 - y)
                g, da = {}, np.zeros_like(a)
                for i, h in enumerate(self.heads):
                    g[f"v{i}"], g[f"c{i}"] = mid[i].T @ dy[:, h], dy[:, h].sum(0)
                    dm = (dy[:, h] @ p[f"v{i}"].T) * (mid[i] > 0)
                    g[f"w{i}"], g[f"b{i}"] = a.T @ dm, dm.sum(0)
                    da += dm @ p[f"w{i}"].T
                da *= a > 0
                g["w"], g["b"] = x[batch].T @ da, da.sum(0)
                step += 1
                for k in p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            error = float(((self._forward(p, x[held])[2] - t[held]) ** 2).mean())
            if error < best - 1e-6:
                best, waited, self.parts = error, 0, {k: a.copy() for k, a in p.items()}
            elif (waited := waited + 1) >= self.patience:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self.parts, x)[2]


def fit_utility_net(train: DataFrame, heads: Sequence[Sequence[int]], features: str = "features", targets: str = "targets", **options) -> UtilityNet:
    """Fit on array columns; the number of rows is checked first."""
    rows = train.select(features, targets).limit(MAX_TRAINING + 1).collect()
    if len(rows) > MAX_TRAINING:
        raise ValueError(f"a fit collects {MAX_TRAINING} rows at most")
    return UtilityNet(heads, **options).fit(np.array([r[0] for r in rows], float), np.clip(np.array([r[1] for r in rows], float), 0, 1))


def predict_utility_net(rows: DataFrame, nets: Sequence[UtilityNet], features: str = "features") -> DataFrame:
    """rows with 'predicted' array<double>: the mean of an ensemble of fold nets (ML-14)."""
    own = list(nets)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        a = np.array(x.tolist(), float)
        return pd.Series(list(np.mean([n.predict(a) for n in own], 0)))

    return rows.withColumn("predicted", run(features))


def hash_folds(rows: DataFrame, group: str, n: int, seed: int = 42) -> DataFrame:
    """rows with 'fold': all rows of a group share one, by a hash (ML-18)."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col(group).cast("string"), F.lit(seed)), F.lit(n)).cast("int"))


def masked_features(wide: DataFrame, metrics: Sequence[str], observed: str = "observed") -> DataFrame:
    """For each metric its value where observed, and flags for observed and valid (RNK-01, RNK-04, FLT-16).

    wide: a map column 'norm' of values and an array column of observed metrics.
    """
    out = []
    for m in metrics:
        seen, value = F.array_contains(observed, m), F.element_at("norm", m)
        out += [F.when(seen, F.coalesce(value, F.lit(0.0))).otherwise(0.0).alias(f"value__{m}"), seen.cast("double").alias(f"observed__{m}"), (seen & value.isNotNull()).cast("double").alias(f"valid__{m}")]
    return wide.select("*", *out)


def candidate_targets(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ARI, regret against the slate's best and rank of each valid candidate (RNK-07, RNK-08)."""
    slate = Window.partitionBy(*keys)
    own = trials.filter("valid and ari is not null")
    return own.withColumns({"regret": F.max("ari").over(slate) - F.col("ari"), "rank": F.rank().over(slate.orderBy(F.desc("ari")))})


def fit_reranker(train: DataFrame, columns: Sequence[str], target: str = "regret", iterations: int = 150, rate: float = 0.08):
    """Histogram gradient boosting of the regret with missing cells as such (RNK-09): a function that adds 'predicted_regret'."""
    model = boosting.fit(train, columns, target, boosting.Settings(rate=rate, iterations=iterations))
    return lambda rows: model.transform(rows, "predicted_regret")


def recovery(best: DataFrame, reranked: str = "reranked", original: str = "original", oracle: str = "oracle", tol: float = 1e-9) -> DataFrame:
    """Share of the oracle's gain that reranking reaches; NULL without a gain (RNK-10)."""
    gain = F.col(oracle) - F.col(original)
    return best.withColumn("recovery", F.when(F.abs(gain) > tol, (F.col(reranked) - F.col(original)) / gain))


def policy_targets(scores: DataFrame, keys: Sequence[str], value: str = "ari") -> DataFrame:
    """ARI, regret to the best policy and centred ARI of each policy (RNK-13)."""
    row = Window.partitionBy(*keys)
    return scores.withColumns({"regret": F.max(value).over(row) - F.col(value), "centered": F.col(value) - F.avg(value).over(row)})


def select_policy(predicted: DataFrame, keys: Sequence[str], target: str, policy: str = "policy") -> DataFrame:
    """Best prediction per row: least regret, else the largest value; ties to the smaller policy (RNK-14)."""
    order = F.asc(target) if "regret" in target else F.desc(target)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order, policy))
    return predicted.withColumn("_n", first).filter("_n = 1").drop("_n")
