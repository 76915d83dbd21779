"""Sequential search by tree-structured Parzen estimators, one cloud a task, clouds in parallel.

The next trial of a cloud is drawn where good trials are denser than the others:
for each parameter a mixture of densities around the values of the good trials
is sampled, and the draw with the largest ratio of both densities is taken. An
algorithm's parameters learn from the trials of that algorithm only. Trial t of
a cloud hangs on the seed, the cloud's keys and the trials before it alone, so
a search goes on from its log as if it had never stopped.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import search

#: Objective of a failed trial.
FAILURE = -1e12
#: Trials drawn at random first, share of good ones and their number at most, draws of which one is taken.
START, GOOD_SHARE, MOST_GOOD, DRAWS = 10, 0.1, 25, 24


@dataclass(frozen=True)
class Choice:
    """One of some values, no order among them."""

    values: tuple

    def uniform(self, rng: np.random.Generator):
        return self.values[int(rng.integers(len(self.values)))]

    def weights(self, seen: Sequence) -> np.ndarray:
        """Share of each value among those seen, with one more trial spread evenly."""
        counts = np.array([sum(v == s for s in seen) for v in self.values], float)
        return (counts + 1 / len(self.values)) / (len(seen) + 1)

    def suggest(self, good: Sequence, rest: Sequence, rng: np.random.Generator):
        near, far = self.weights(good), self.weights(rest)
        draws = rng.choice(len(self.values), DRAWS, p=near / near.sum())
        return self.values[int(draws[np.argmax(np.log(near[draws]) - np.log(far[draws]))])]


@dataclass(frozen=True)
class Range:
    """Numbers from low to high; whole ones if step is set, on a log scale if log is."""

    low: float
    high: float
    step: int | None = None
    log: bool = False

    def _inside(self) -> tuple[float, float]:
        """Ends of the line that densities live on: half a step more on both sides for whole numbers."""
        if self.step:
            return self.low - self.step / 2, self.high + self.step / 2
        return (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)

    def _value(self, u: float):
        if self.step:
            places = min(max(round((u - self.low) / self.step), 0), int((self.high - self.low) // self.step))
            return int(self.low + self.step * places)
        return float(min(max(math.exp(u) if self.log else u, self.low), self.high))

    def uniform(self, rng: np.random.Generator):
        return self._value(rng.uniform(*self._inside()))

    def mixture(self, seen: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """Centres and widths: one of the whole range, and one a value, as wide as its larger gap to a neighbour."""
        a, z = self._inside()
        own = np.array(sorted(math.log(v) if self.log else float(v) for v in seen))
        edges = np.concatenate([[a], own, [z]])
        gaps = np.diff(edges)
        wide = np.clip(np.maximum(gaps[:-1], gaps[1:]), (z - a) / min(100, len(own) + 2), z - a) if len(own) else own
        return np.append(own, (a + z) / 2), np.append(wide, z - a)

    def log_density(self, at: np.ndarray, seen: Sequence) -> np.ndarray:
        """Of truncated normal mixtures; a whole number gets the mass of its cell."""
        a, z = self._inside()
        centre, wide = self.mixture(seen)
        inside = _normal_cdf((z - centre) / wide) - _normal_cdf((a - centre) / wide)
        if self.step:
            half = self.step / 2
            mass = _normal_cdf((at[:, None] + half - centre) / wide) - _normal_cdf((at[:, None] - half - centre) / wide)
        else:
            mass = np.exp(-0.5 * ((at[:, None] - centre) / wide) ** 2) / (wide * math.sqrt(2 * math.pi))
        return np.log(np.maximum((mass / inside).mean(1), 1e-300))

    def suggest(self, good: Sequence, rest: Sequence, rng: np.random.Generator):
        a, z = self._inside()
        centre, wide = self.mixture(good)
        drawn = []
        for i in rng.integers(len(centre), size=DRAWS):
            u = rng.normal(centre[i], wide[i])
            while not a <= u <= z:  # each mixture part has its centre inside
                u = rng.normal(centre[i], wide[i])
            drawn.append(u)
        values = [self._value(u) for u in drawn]
        at = np.array([math.log(v) if self.log else v for v in values], float)
        return values[int(np.argmax(self.log_density(at, good) - self.log_density(at, rest)))]


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


def dimension(spec) -> Choice | Range:
    """A parameter's specification as what can be searched (CLU-01).

    A list or tuple holds values; a mapping has type 'categorical' with choices,
    or 'int' or 'float' with low and high, and may have step or log. A range of
    one number is one value.
    """
    if isinstance(spec, Mapping):
        kind = spec.get("type")
        if kind == "categorical":
            return Choice(tuple(spec["choices"]))
        if kind not in ("int", "float"):
            raise ValueError(f"unknown type of parameter: {kind!r}")
        if spec["low"] == spec["high"]:
            return Choice((spec["low"],))
        return Range(spec["low"], spec["high"], int(spec.get("step", 1)) if kind == "int" else None, bool(spec.get("log")) and kind == "float")
    values = tuple(spec) if isinstance(spec, (list, tuple)) else (spec,)
    if not values:
        raise ValueError("a parameter without values")
    return Choice(values)


def dimensions(space: Mapping) -> dict[str, dict[str, Choice | Range]]:
    if not space:
        raise ValueError("the search space has no algorithm")
    return {a: {p: dimension(s) for p, s in sorted(own.items())} for a, own in sorted(space.items())}


def is_good(scores: Sequence[float]) -> np.ndarray:
    """Mask of the best tenth of the trials, MOST_GOOD at most; equal scores count by age."""
    order = np.argsort(-np.asarray(scores, float), kind="stable")
    out = np.zeros(len(scores), bool)
    out[order[: min(math.ceil(GOOD_SHARE * len(scores)), MOST_GOOD)]] = True
    return out


def suggest(dims: Mapping[str, Mapping[str, Choice | Range]], history: Sequence[tuple[str, dict, float]], rng: np.random.Generator, sampler: str = "tpe") -> tuple[str, dict]:
    """Algorithm and parameters of the next trial after (algorithm, parameters, objective) rows."""
    names = Choice(tuple(dims))
    if sampler == "random" or len(history) < START:
        name = names.uniform(rng)
        return name, {p: d.uniform(rng) for p, d in dims[name].items()}
    good = is_good([s for _, _, s in history])
    split = lambda of: ([of(h) for h, g in zip(history, good, strict=True) if g and of(h) is not None], [of(h) for h, g in zip(history, good, strict=True) if not g and of(h) is not None])
    name = names.suggest(*split(lambda h: h[0]), rng)
    return name, {p: d.suggest(*split(lambda h, p=p: h[1].get(p) if h[0] == name else None), rng) for p, d in dims[name].items()}


def trial_rng(seed: int, key: Sequence, number: int) -> np.random.Generator:
    return np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(repr([str(k) for k in key]).encode()), number])


def objective(norms: Mapping[str, float], weights: Mapping[str, float], valid: bool) -> float:
    """Weighted mean of the normalised indices; FAILURE for a failed trial."""
    total = sum(weights.values())
    return sum(weights[m] * norms[m] for m in weights) / total if valid and total > 0 else FAILURE


def search_cloud(x: np.ndarray, key: Sequence, dims: Mapping, weights: Mapping[str, float], n_trials: int, seed: int, evaluate, sampler: str = "tpe", patience: int | None = None, history: Sequence[tuple[str, dict, float]] = ()) -> list[dict]:
    """The trials of one cloud after those of history: number, algorithm, config, objective, and what evaluate gives.

    evaluate(x, algorithm, parameters) gives a dict with norms and valid. The
    same configuration is evaluated once. With patience the search ends after
    so many trials in a row without a better objective.
    """
    past, out, known = list(history), [], {}
    best, idle = -math.inf, 0
    for _, _, score in past:
        best, idle = (score, 0) if score > best else (best, idle + 1)
    while len(past) < n_trials and not (patience is not None and past and idle >= patience):
        number = len(past) + 1
        name, config = suggest(dims, past, trial_rng(seed, key, number), sampler)
        written = json.dumps(config, sort_keys=True)
        if (name, written) not in known:
            known[name, written] = evaluate(x, name, config)
        found = known[name, written]
        score = objective(found["norms"], weights, found["valid"])
        best, idle = (score, 0) if score > best else (best, idle + 1)
        past.append((name, config, score))
        out.append({"candidate": number, "algorithm": name, "config": written, "objective": score, **found})
    return out


def run_search(
    points: DataFrame, space: Mapping = search.SPACE, n_trials: int = 50, seed: int = 42, keys: Sequence[str] = ("dataset_id",), weights: Mapping[str, float] | None = None,
    sampler: str = "tpe", patience: int | None = None, log: DataFrame | None = None, seconds: float | None = None,
) -> DataFrame:
    """Trial log of a sequential search of each cloud (OBJ-17, OBJ-18, OBJ-05): the columns of search.run_trials and objective.

    weights: index to weight, all registered ones equal by default. log: trials
    run before, of the same search; only later ones are run and returned. seconds:
    time limit of a trial. A cloud is searched in one task; no cloud waits for another.
    """
    if sampler not in ("tpe", "random"):
        raise ValueError(f"unknown sampler: {sampler!r}")
    names, dims = list(keys), dimensions(space)
    weights = dict(weights or dict.fromkeys(search.METRICS, 1.0))
    evaluate = search.evaluator(tuple(weights), tuple(dims), seconds)

    def run(key: tuple, rows: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
        out = []
        if len(rows):
            past = [] if before is None else before.drop_duplicates("candidate").sort_values("candidate")
            history = [(r.algorithm, json.loads(r.config), float(r.objective)) for r in past.itertuples()] if len(past) else []
            x = rows.sort_values("point_id")[["x", "y"]].to_numpy(float)
            for t in search_cloud(x, key, dims, weights, n_trials, seed, evaluate, sampler, patience, history):
                base = {**dict(zip(names, key, strict=True)), **{c: t[c] for c in ("candidate", "algorithm", "config", "valid", "n_clusters", "noise_ratio", "exception", "objective")}}
                out += [{**base, "metric_id": m, "raw": t["raws"][m], "norm": t["norms"][m]} for m in weights]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    ddl = search.log_ddl(points, names) + ", objective double"
    cloud = search.spread(points.select(*names, "point_id", "x", "y"), *names).groupBy(*names)
    if log is None:
        return cloud.applyInPandas(lambda key, rows: run(key, rows), ddl)
    told = log.select(*names, "candidate", "algorithm", "config", "objective").distinct()
    return cloud.cogroup(told.groupBy(*names)).applyInPandas(lambda key, rows, before: run(key, rows, before), ddl)
