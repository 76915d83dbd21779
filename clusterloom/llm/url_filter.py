"""URL filter: host and path rules, and boosted trees for the URLs without a rule.

The trees are trained on the URLs that a rule labels, by DataFrame operations:
features are cut into quantile bins, every tree level is one aggregation of
gradient sums by leaf, feature and bin, and a fitted tree is a CASE
expression. Gradients are summed as whole numbers, so reruns agree.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

# The rules of the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labelled URLs a fit reads at most, lowest hash first.
MAX_TRAINING = 50_000
ROUNDS, DEPTH, RATE, RIDGE, BINS = 16, 3, 0.4, 1.0, 16
#: Tasks that share the training rows.
TRAINING_TASKS = 16
#: Buckets of hashed suffixes and first path segments.
SUFFIXES = 256
UNIT = float(1 << 20)
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "host_labels", "is_https", "suffix_rate", "suffix_share", "segment_rate", "extension_rate")


def parse(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): host after the first '://' up to '/', '?', '#', A-Z lower-cased; path up to '?' or '#'."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(text, pattern, 2)


def matched_rule(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...]) -> tuple[F.Column, F.Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for effect, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, effect).otherwise(verdict)
    return rule, verdict


def _entropy(text: F.Column) -> F.Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    shares = F.transform(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), share)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def _keys() -> dict[str, F.Column]:
    """Hash buckets of the host's last label, the first path segment and the file extension."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(SUFFIXES)).cast("int")
    return {
        "suffix": bucket(F.substring_index("host", ".", -1)),
        "segment": bucket(F.regexp_extract("path", "^/([^/]*)", 1)),
        "extension": bucket(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,6})$", 1)),
    }


def _array(values) -> F.Column:
    return F.expr("array(" + ", ".join(_number(v) for v in values) + ")")


def _number(v: float) -> str:
    """A double in SQL: one text is parsed faster than many columns are put together."""
    return f"{float(v)!r}D"


@dataclass
class UrlModel:
    """Bin edges of each feature, suffix statistics, trees and the score of no tree."""

    start: float
    stats: dict[str, list[float]]
    edges: list[list[float]]
    trees: list

    def features(self) -> list[F.Column]:
        url = F.coalesce(F.col("url"), F.lit(""))
        keys = _keys()
        digits = F.length(url) - F.length(F.translate(url, string.digits, ""))
        count = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))).cast("double")
        return [
            F.length(url).cast("double"),
            F.length("host").cast("double"),
            count(F.col("path"), "/"),
            digits / F.greatest(F.length(url), F.lit(1)),
            _entropy(url),
            count(url, "&") + count(url, "?"),
            count(F.col("host"), "-"),
            count(F.col("host"), "."),
            F.startswith(F.lower(url), F.lit("https://")).cast("double"),
            _array(self.stats["suffix"])[keys["suffix"]],
            _array(self.stats["share"])[keys["suffix"]],
            _array(self.stats["segment"])[keys["segment"]],
            _array(self.stats["extension"])[keys["extension"]],
        ]

    def binned(self) -> F.Column:
        """Array of the number of edges below each feature; a lambda variable holds the value, so it is computed once."""
        edges = F.array(*(_array(e).cast("array<double>") for e in self.edges))
        return F.transform(F.array(*self.features()), lambda value, i: F.size(F.filter(edges[i], lambda e: e < value)))

    def score(self) -> F.Column:
        """Log odds of 'block' from the column bins."""
        return F.expr(" + ".join([_number(self.start), *(_value(tree) for tree in self.trees)]))


def _value(tree) -> str:
    if isinstance(tree, float):
        return _number(tree)
    feature, upto, low, high = tree
    return f"CASE WHEN bins[{feature}] <= {upto} THEN {_value(low)} ELSE {_value(high)} END"


def _leaf(tree, at: int = 0) -> str:
    """Heap index of the leaf that a row is in."""
    if isinstance(tree, float):
        return str(at)
    feature, upto, low, high = tree
    return f"CASE WHEN bins[{feature}] <= {upto} THEN {_leaf(low, 2 * at + 1)} ELSE {_leaf(high, 2 * at + 2)} END"


def _splits(rows) -> dict[int, tuple]:
    """Best (feature, bin, value below, value above) of each leaf with a gain, or (None, value)."""
    leaves: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for r in rows:
        leaves.setdefault(r.leaf, {}).setdefault(r.feature, {})[r.bin] = r.g / UNIT, r.h / UNIT
    out = {}
    for leaf, features in leaves.items():
        g_all, h_all = (sum(x[i] for x in next(iter(features.values())).values()) for i in (0, 1))
        step = lambda g, h: -RATE * g / (h + RIDGE)
        best: tuple = (1e-6, None, step(g_all, h_all))
        for feature, bins in sorted(features.items()):
            g = h = 0.0
            for b in sorted(bins)[:-1]:
                g, h = g + bins[b][0], h + bins[b][1]
                gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, feature, b, step(g, h), step(g_all - g, h_all - h))
        out[leaf] = best[1:]
    return out


def _grow(tree, splits: dict[int, tuple], at: int = 0):
    if isinstance(tree, float):
        found = splits.get(at)
        if found is None:
            return tree
        return float(found[1]) if found[0] is None else (found[0], found[1], float(found[2]), float(found[3]))
    feature, upto, low, high = tree
    return feature, upto, _grow(low, splits, 2 * at + 1), _grow(high, splits, 2 * at + 2)


def fit_urls(labelled: DataFrame, max_training: int = MAX_TRAINING, rounds: int = ROUNDS, depth: int = DEPTH) -> UrlModel:
    """Boosted trees on labelled (url, host, path, block boolean), max_training different URLs at most.

    Without labels, as with an empty table, the model says allow, with one
    class that class. Repeated urls count once, labelled both ways as block.
    Whole urls are measured, however long.
    """
    one = labelled.filter("block is not null").groupBy("url", "host", "path").agg(F.max("block").alias("block"))
    sample = materialize(one.orderBy(F.xxhash64("url"), "url").limit(max_training).repartition(TRAINING_TASKS, "url").withColumns(_keys()), "urls")
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("block").cast("long")), F.lit(0)).alias("y")).first()
    prior = (total.y + 0.5) / (total.n + 1)
    model = UrlModel(-1.0 if not total.n else math.log(prior / (1 - prior)), {}, [[] for _ in FEATURES], [])
    for name in ("suffix", "segment", "extension"):
        # SUFFIXES rows at most.
        seen = {r[name]: (r.n, r.y) for r in sample.groupBy(name).agg(F.count("*").alias("n"), F.sum(F.col("block").cast("long")).alias("y")).collect()}
        model.stats[name] = [(seen.get(i, (0, 0))[1] + prior) / (seen.get(i, (0, 0))[0] + 1) for i in range(SUFFIXES)]
        if name == "suffix":
            model.stats["share"] = [seen.get(i, (0, 0))[0] / max(1, total.n) for i in range(SUFFIXES)]
    if not 0 < total.y < total.n:
        return model
    cuts = _array([i / BINS for i in range(1, BINS)])
    measured = sample.select(*(c.alias(n) for n, c in zip(FEATURES, model.features(), strict=True)))
    edges = measured.agg(*(F.percentile_approx(n, cuts, F.lit(10_000)).alias(n) for n in FEATURES)).first()
    model.edges = [sorted({float(e) for e in edges[n]}) for n in FEATURES]
    rows = materialize(sample.select(F.col("block").cast("double").alias("y"), model.binned().alias("bins")), "bins")
    for _ in range(rounds):
        odds = model.score()
        chance = 1 / (1 + F.exp(-odds))
        tree = 0.0
        for _ in range(depth):
            graded = rows.select("bins", F.expr(_leaf(tree)).alias("leaf"), chance.alias("p"), "y").select(
                "leaf", F.posexplode("bins").alias("feature", "bin"), F.round((F.col("p") - F.col("y")) * UNIT).cast("long").alias("g"), F.round(F.col("p") * (1 - F.col("p")) * UNIT).cast("long").alias("h")
            )
            # Leaves x features x bins rows at most.
            tree = _grow(tree, _splits(graded.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()))
        model.trees.append(tree)
    return model


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, chance) of every row.

    verdict is the longest fitting rule's, else 'block' where the trees give a
    chance of 0.5 or more. A url that is null or has no '://' has an empty host
    and path and is judged by the trees; each row, repeated ones too, is judged,
    and an empty table gives no rows. Other columns of pages are not read.
    """
    host, path = parse(F.col("url"))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "ruled": verdict})
    model = fit_urls(ruled.filter("rule is not null").select("url", "host", "path", (F.col("ruled") == "block").alias("block")))
    scored = ruled.withColumn("bins", model.binned()).withColumn("chance", 1 / (1 + F.exp(-model.score())))
    judged = F.coalesce("ruled", F.when(F.col("chance") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", judged.alias("verdict"), "chance")


def url_digest(pages: DataFrame) -> DataFrame:
    """The result of the registered query."""
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
