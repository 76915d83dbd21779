"""Comparison suites over best-view frames: trace gaps, declared contrasts, hypotheses, capabilities and their checks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import portfolio, resampling, statistics
from .frames import UNIT, best_view_frame, succeeded
from .pairing import all_pairs
from .ranking import average_rank
from .summaries import q, summarize_by, summarize_methods

VIEWS = ("x_only", "y_only", "xy_2d")
#: Share of a method's rows that must provide a capability.
AVAILABLE = 0.99
# The capabilities that each analysis of the protocol asks for.
REQUIREMENTS = {
    "primary_ari": ("raw_result", "external_ari"),
    "best_view": ("raw_result", "external_ari", "three_views"),
    "k_analysis": ("selected_k", "true_k"),
    "runtime_best_view": ("runtime",),
    "runtime_total_all_views": ("all_view_runtime",),
    "vbs": ("raw_result", "external_ari"),
}


def attach_trace_gap(best: DataFrame, traces: DataFrame) -> DataFrame:
    """Best-view rows with what the search trace of their view knew (JOIN-05).

    traces: dataset_id, view_id, method_name, trace_best_ari, n_trace_candidates; of repeated keys one row counts.
    """
    keys = ["dataset_id", "best_view", "method_name"]
    one = traces.withColumnRenamed("view_id", "best_view").dropDuplicates(keys).select(*keys, "trace_best_ari", "n_trace_candidates")
    gap = F.col("trace_best_ari") - F.col("best_ari")
    return best.join(one, keys, "left").withColumn("trace_gap", gap).withColumn("selected_is_trace_best", F.abs("trace_gap") <= portfolio.TIE)


def trace_gap_summary(attached: DataFrame, keys: Sequence[str] = ("method_name",)) -> DataFrame:
    """What the choice among a trace's candidates cost (PF-23, AGG-02); groups without a trace are left out."""
    gap = F.col("trace_gap")
    return attached.filter(gap.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_with_trace"),
        F.avg("trace_best_ari").alias("trace_best_mean"),
        F.avg("best_ari").alias("selected_mean"),
        F.avg(gap).alias("gap_mean"),
        q(gap, 0.5).alias("gap_median"),
        q(gap, 0.75).alias("gap_q75"),
        F.max(gap).alias("gap_max"),
        F.avg(F.col("selected_is_trace_best").cast("double")).alias("trace_best_rate"),
        F.avg("n_trace_candidates").alias("n_candidates_mean"),
    )


def view_summary(runs: DataFrame, keys: Sequence[str] = ("method_name",)) -> DataFrame:
    """Best-view mean beside the mean of all views, and how often each view is best (JOIN-07): two aggregations, no join."""
    wins = [F.count_if(F.col("best_view") == v).alias(f"best_view_{v}") for v in VIEWS]
    every = F.sum(F.col("view_mean") * F.col("n_success")) / F.nullif(F.sum("n_success"), F.lit(0))
    return best_view_frame(runs).groupBy(*keys).agg(F.avg("best_ari").alias("best_view_mean"), every.alias("all_views_mean"), *wins)


def pivot_arms(best: DataFrame, arms: Sequence[str], metadata: DataFrame | None = None, value: str = "best_ari") -> DataFrame:
    """One column an arm, beside the dataset's metadata (JOIN-08, SET-10)."""
    wide = best.groupBy("dataset_id").pivot("method_name", list(arms)).agg(F.max(value))
    return wide.join(metadata, "dataset_id") if metadata is not None else wide


def arm_contrasts(wide: DataFrame, contrasts: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(label, n, mean, median, positive_share) of declared differences of columns (ST-24, ST-23)."""
    stacked = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), (F.col(a) - F.col(b)).alias("delta")) for label, a, b in contrasts))).alias("x")
    rows = wide.select(stacked).select("x.*").filter("delta is not null")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), q("delta", 0.5).alias("median"), F.avg((F.col("delta") > 0).cast("double")).alias("positive_share"))


def top_k_comparison(runs: DataFrame, sizes: Mapping[str, int], entropy: str = "weight_entropy") -> DataFrame:
    """The summary block of the methods that differ in K only, with K and mean weight entropy (AGG-17)."""
    own = runs.filter(F.col("method_name").isin(*sizes))
    k = reduce(lambda c, x: c.when(F.col("method_name") == x[0], x[1]), list(sizes.items())[1:], F.when(F.col("method_name") == next(iter(sizes)), next(iter(sizes.values()))))
    ari = F.when(succeeded(), F.col("ari"))
    return own.groupBy("method_name").agg(F.count("*").alias("n"), F.avg(ari).alias("ari_mean"), q(ari, 0.5).alias("ari_median"), F.avg(F.when(succeeded(), F.col("runtime_sec"))).alias("runtime_mean"), F.avg(F.when(F.col("status") == "success", F.col(entropy))).alias("entropy_mean")).withColumn("top_k", k)


def external_metric_table(runs: DataFrame, metrics: Sequence[str], group: str = "method_name") -> DataFrame:
    """Mean and deviation of agreement metrics, successes only (AGG-18)."""
    columns = [f(m).alias(f"{name}_{m}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return runs.filter("status = 'success'").groupBy(group).agg(F.count("*").alias("n"), *columns)


def new_metric_usage_per_run(long: DataFrame, new: Sequence[str], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Count, fraction and weight mass of the new indices in each run, and whether the heaviest is new (AGG-26).

    long: keys, metric_id, weight.
    """
    is_new = F.col("metric_id").isin(*new)
    top = F.max(F.struct("weight", F.col("metric_id").alias("m"))).getField("m")
    per = long.groupBy(*keys).agg(F.count("*").alias("n_selected"), F.count_if(is_new).alias("new_count"), F.coalesce(F.sum(F.when(is_new, F.col("weight"))), F.lit(0.0)).alias("new_mass"), F.sum("weight").alias("total"), top.isin(*new).alias("top_is_new"))
    return per.select(*keys, "n_selected", "new_count", "new_mass", (F.col("new_count") / F.col("n_selected")).alias("new_fraction"), (F.col("new_mass") / F.nullif("total", F.lit(0.0))).alias("new_share"), "top_is_new")


def new_metric_usage(per_run: DataFrame, keys: Sequence[str] = ("method_name",)) -> DataFrame:
    """Averages of new_metric_usage_per_run() by group (AGG-27)."""
    return per_run.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), F.avg("new_count").alias("count_mean"), F.avg("new_fraction").alias("fraction_mean"), q("new_fraction", 0.5).alias("fraction_median"), F.avg("new_mass").alias("mass_mean"), F.avg("new_share").alias("share_mean"),
        F.avg((F.col("new_count") > 0).cast("double")).alias("with_new"), F.avg(F.col("top_is_new").cast("double")).alias("top_new"),
    )


def new_metric_gain(per_run: DataFrame, best: DataFrame, reference: str) -> DataFrame:
    """Pearson and Spearman of new-index mass and ARI gain over a reference method, an association only (AGG-29).

    per_run: dataset_id, method_name, new_mass. Fewer than three pairs, or a constant side, give NULL.
    """
    ref = best.filter(F.col("method_name") == reference).select("dataset_id", F.col("best_ari").alias("ref"))
    met = per_run.join(best.select(*UNIT, "best_ari"), list(UNIT)).join(ref, "dataset_id").withColumn("gain", F.col("best_ari") - F.col("ref")).filter("gain is not null and new_mass is not null")
    ranked = met.withColumns({"x": average_rank(["method_name"], "new_mass"), "y": average_rank(["method_name"], "gain")})
    told = (F.count("*") >= 3) & (F.stddev_pop("new_mass") > 0) & (F.stddev_pop("gain") > 0)
    return ranked.groupBy("method_name").agg(F.count("*").alias("n"), F.avg("new_mass").alias("mass_mean"), F.avg("gain").alias("gain_mean"), F.when(told, F.corr("new_mass", "gain")).alias("pearson"), F.when(told, F.corr("x", "y")).alias("spearman"))


def enrichment(long: DataFrame, group: str) -> DataFrame:
    """Share of each metric among a group's slots over its share of all slots (JOIN-09)."""
    counts = long.groupBy(group, "metric_id").agg(F.count("*").alias("n"))
    own = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    overall = F.sum("n").over(Window.partitionBy("metric_id")) / F.sum("n").over(Window.partitionBy())
    return counts.select(group, "metric_id", "n", own.alias("rate"), overall.alias("global_rate"), (own / overall).alias("enrichment"))


def metric_master(base: DataFrame, *facts: DataFrame) -> DataFrame:
    """One row a metric with the columns of all fact tables (JOIN-10)."""
    return reduce(lambda a, b: a.join(b, "metric_id", "left"), facts, base)


def paired_predictions(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str] = ("dataset_id", "view_id")) -> DataFrame:
    """Two prediction tables side by side (JOIN-11)."""
    return a.select(*keys, F.col(value).alias("value_a")).join(b.select(*keys, F.col(value).alias("value_b")), list(keys))


def verify_released(runs: DataFrame, released: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Units whose released best ARI differs from the recomputed one, or is missing (JOIN-12). released: dataset_id, method_name, released."""
    got = runs.filter(succeeded()).groupBy(*UNIT).agg(F.max("ari").alias("recomputed"))
    met = got.join(released, list(UNIT), "full")
    return met.filter(F.coalesce(F.abs(F.col("recomputed") - F.col("released")) > tol, F.lit(True)))


def gap_table(best: DataFrame, contrasts: Sequence[tuple[str, str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """(gap_type, keys, reference, comparison, ...) of declared contrasts, reference minus comparison (PF-17, PF-19 to PF-21, PF-24, ST-28).

    All contrasts come from one pass over the pairs; contrasts are a short list.
    """
    declared = F.broadcast(best.sparkSession.createDataFrame([tuple(c) for c in contrasts], "gap_type string, method string, baseline string"))
    d = F.col("delta")
    rows = all_pairs(best, keys).join(declared, ["method", "baseline"])
    return rows.groupBy("gap_type", *keys, "method", "baseline").agg(
        F.count("*").alias("n"), F.avg(d).alias("gap_mean"), q(d, 0.5).alias("gap_median"), F.stddev_samp(d).alias("gap_std"), q(d, 0.25).alias("gap_q25"), q(d, 0.75).alias("gap_q75"),
        F.avg((d > 1e-12).cast("double")).alias("reference_better"), F.avg((F.abs(d) <= 1e-12).cast("double")).alias("equal"), F.avg((d < -1e-12).cast("double")).alias("comparison_better"),
    )


def variant_contrasts(methods: Sequence[Mapping[str, str]], field: str, reference: str, comparison: str, gap_type: str) -> list[tuple[str, str, str]]:
    """Pairs of registered methods that differ in one field only: reference value against comparison value (PF-19 to PF-21)."""
    rest = lambda m: tuple(sorted((k, v) for k, v in m.items() if k not in ("method_name", field)))
    left = {rest(m): m["method_name"] for m in methods if m[field] == reference}
    return sorted((gap_type, left[rest(m)], m["method_name"]) for m in methods if m[field] == comparison and rest(m) in left)


def external_contrasts(external: Sequence[str], representatives: Sequence[str]) -> list[tuple[str, str, str]]:
    """Each external method against each representative (PF-24)."""
    return [("external_leader_gap", e, r) for e in external for r in representatives if e != r]


def criterion_table(best: DataFrame, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every method against one reference policy: means, paired gap and effect size (ST-28)."""
    pairs = all_pairs(best, keys).filter(F.col("baseline") == reference)
    return statistics.effect_sizes(pairs, [*keys, "method", "baseline"])


def student_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    if t != t or df != df or df <= 0:
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tail = 0.0
    for k in range(400, 0, -1):  # from the innermost term outwards
        m = k // 2
        top = m * (b - m) * x / ((a + k - 1) * (a + k)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + k - 1) * (a + k))
        tail = top / (1 + tail)
    p = front / (1 + tail)
    return 1 - p if flip else p


def paired_t(deltas: DataFrame, keys: Sequence[str], value: str = "delta") -> DataFrame:
    """(keys, n, t, df, dz, t_p): paired Student's t and Cohen's dz (ST-17); NULL for a constant difference or one pair."""
    p = F.pandas_udf(lambda t, df: pd.Series([student_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64"), "double")
    d = F.col(value)
    per = deltas.filter(d.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    dz = F.when(F.col("s") > 0, F.col("m") / F.col("s"))
    shaped = per.select(*keys, "n", (dz * F.sqrt("n")).alias("t"), (F.col("n") - 1).cast("double").alias("df"), dz.alias("dz"))
    return shaped.withColumn("t_p", F.nanvl(p(F.col("t"), F.col("df")), F.lit(None).cast("double")))


def paired_contrast(deltas: DataFrame, keys: Sequence[str], draws: int = 2000) -> DataFrame:
    """The full paired block (ST-05): effect sizes, signed ranks with p, paired t, and a bootstrap interval of the mean over datasets."""
    effect = statistics.effect_sizes(deltas, keys)
    ranks = statistics.signed_rank_p(deltas, keys).select(*keys, "w_plus", "w_minus", "rank_biserial", "p_value")
    t = paired_t(deltas, keys).select(*keys, "t", "t_p")
    interval = resampling.bootstrap(deltas, keys, "delta", "dataset_id", draws)
    return reduce(lambda a, b: a.join(b, list(keys), "left"), (ranks, t, interval), effect)


def run_hypotheses(best: DataFrame, hypotheses: Sequence[tuple[str, str, str, str]], group: Sequence[str] = (), draws: int = 2000) -> DataFrame:
    """A row for each hypothesis (id, family, method, baseline) and group, with Holm-adjusted p by family (ST-09, ST-11)."""
    declared = F.broadcast(best.sparkSession.createDataFrame([tuple(h) for h in hypotheses], "hypothesis string, test_family string, method string, baseline string"))
    keys = ["hypothesis", "test_family", *group, "method", "baseline"]
    deltas = all_pairs(best, group).join(declared, ["method", "baseline"])
    return statistics.holm(paired_contrast(deltas, keys, draws), ["test_family", *group])


def mann_whitney(values: DataFrame, keys: Sequence[str], side: str, value: str) -> DataFrame:
    """(keys, n_in, n_out, u, z, p_value) of rows where side is true against the others (ST-21), ties corrected; fewer than 3 of a side give NULL."""
    p = F.pandas_udf(lambda z: pd.Series([math.erfc(abs(x) / math.sqrt(2)) if x == x else math.nan for x in z], dtype="float64"), "double")
    told = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(side).isNotNull())
    ranked = told.withColumns({"_r": average_rank(keys, value), "_t": F.count("*").over(Window.partitionBy(*keys, value))})
    t = F.col("_t").cast("double")
    per = ranked.groupBy(*keys).agg(F.count_if(F.col(side)).alias("n_in"), F.count_if(~F.col(side)).alias("n_out"), F.sum(F.when(F.col(side), F.col("_r"))).alias("_w"), F.sum(t * t - 1).alias("_ties"))
    a, b = F.col("n_in").cast("double"), F.col("n_out").cast("double")
    n, u = a + b, F.col("_w") - a * (a + 1) / 2
    spread = F.sqrt(a * b / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = F.when((a >= 3) & (b >= 3) & (spread > 0), (F.abs(u - a * b / 2) - 0.5) / spread)
    shaped = per.select(*keys, "n_in", "n_out", u.alias("u"), z.alias("z"))
    return shaped.withColumn("p_value", F.least(F.lit(1.0), F.nanvl(p("z"), F.lit(None).cast("double"))))


def bootstrap_columns(values: DataFrame, columns: Sequence[str], unit: str, draws: int = 2000) -> DataFrame:
    """(column_name, low, high): bootstrap interval of the mean of each column (ST-19)."""
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")
    return resampling.bootstrap(values.select(unit, stacked).select(unit, "x.*"), ["column_name"], "value", unit, draws)


def family_divergence(best: DataFrame, scope: str = "family") -> DataFrame:
    """The method chosen for each family beside the global choice, and how often they differ (PF-03)."""
    chosen = portfolio.representative(best).select(F.col("selected").alias("global_selected"))
    per = portfolio.representative(best, [scope]).select(scope, F.col("selected").alias("family_selected"), F.col("selected_mean").alias("family_mean"))
    met = per.join(F.broadcast(chosen)).withColumn("differs", F.col("family_selected") != F.col("global_selected"))
    return met.withColumn("divergence_rate", F.avg(F.col("differs").cast("double")).over(Window.partitionBy()))


def global_choice_by_family(best: DataFrame, scope: str = "family") -> DataFrame:
    """How the globally chosen method does in each family (PF-04)."""
    chosen = portfolio.representative(best).select(F.col("selected").alias("method_name"))
    return summarize_methods(best.join(F.broadcast(chosen), "method_name"), [scope, "method_name"])


def selection_winners(best: DataFrame, repeats: int = 3) -> DataFrame:
    """The choice from differently dealt copies of the input (PF-05): one row where it is deterministic."""
    dealt = [portfolio.representative(best.repartition(4 + i, F.xxhash64("dataset_id", "method_name", F.lit(i)))).select("selected") for i in range(repeats)]
    return reduce(DataFrame.union, dealt).groupBy("selected").agg(F.count("*").alias("n"))


def stability_by(best: DataFrame, scope: str = "family", draws: int = 1000, least: int = 2) -> DataFrame:
    """selection_stability() of each family's pool of two methods or more (PF-07)."""
    pools = best.groupBy(scope).agg(F.countDistinct("method_name").alias("n")).filter(F.col("n") >= least).select(scope)
    return portfolio.selection_stability(best.join(pools, scope), draws, keys=[scope])


def greedy_membership(greedy: DataFrame) -> DataFrame:
    """Which methods a greedy portfolio holds after each step (PF-13), and its share of the achievable gain."""
    up = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row a method
    whole = Window.partitionBy()
    first, last = F.min_by("portfolio_mean", "step").over(whole), F.max("portfolio_mean").over(whole)
    share = F.when(last - first > portfolio.TIE, (F.col("portfolio_mean") - first) / (last - first)).otherwise(1.0)
    return greedy.select("step", F.col("method_name").alias("added"), F.array_join(F.collect_list("method_name").over(up), ";").alias("members"), "gain", share.alias("gain_share"))


def matched_sizes(curve: DataFrame, sizes: Sequence[int] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Rows of a size curve at declared sizes (SET-14)."""
    return curve.filter(F.col("size").isin(*sizes)).withColumn("label", F.concat(F.lit("top "), F.col("size").cast("string")))


def vbs_problems(vbs: DataFrame, best: DataFrame, larger: DataFrame | None = None) -> DataFrame:
    """(problem, n) of a virtual best that breaks its rules (PF-16): one row a dataset, cost the sum and ARI the maximum of its members,
    and no larger portfolio below it. Without problems the table is empty."""
    want = best.groupBy("dataset_id").agg(F.sum("total_runtime_sec").alias("cost"), F.max("best_ari").alias("top"), F.collect_set("method_name").alias("members"))
    met = vbs.join(want, "dataset_id", "left")
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= 1e-6, F.col(a).isNull() & F.col(b).isNull())
    checks = {
        "cost": ~near("portfolio_runtime_sec", "cost"),
        "ari": ~near("vbs_ari", "top"),
        "winner": ~F.coalesce(F.array_contains("members", F.col("winner")), F.lit(False)),
    }
    broken = met.select(F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))).alias("problem"))
    twice = vbs.groupBy("dataset_id").count().filter("count > 1").select(F.lit("repeated").alias("problem"))
    found = broken.union(twice)
    if larger is not None:
        both = vbs.select("dataset_id", "vbs_ari").join(larger.select("dataset_id", F.col("vbs_ari").alias("more")), "dataset_id")
        found = found.union(both.filter(F.col("more") < F.col("vbs_ari") - portfolio.TIE).select(F.lit("monotone").alias("problem")))
    return found.groupBy("problem").agg(F.count("*").alias("n"))


def frame_problems(runs: DataFrame, best: DataFrame, expected_views: int = len(VIEWS)) -> DataFrame:
    """(problem, n) of run and best-view frames that break their structure (PF-27)."""
    keys = [*UNIT, "view_id"]
    per = runs.groupBy(*UNIT).agg(F.count("*").alias("n"), F.countDistinct("view_id").alias("v"), F.max(F.when(succeeded(), F.col("ari"))).alias("top"))
    met = per.join(best.select(*UNIT, F.col("best_ari").alias("got"), F.lit(True).alias("has")), list(UNIT), "full")
    wrong = ~F.coalesce(F.abs(F.col("top") - F.col("got")) <= 1e-9, F.col("top").isNull() & F.col("got").isNull())
    checks = {"views": F.coalesce(F.col("n") != expected_views, F.lit(True)), "unit_missing": F.col("has").isNull(), "best_ari": wrong}
    one = met.select(F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))).alias("problem"))
    twice = [df.groupBy(*k).count().filter("count > 1").select(F.lit(name).alias("problem")) for df, k, name in ((runs, keys, "run_repeated"), (best, UNIT, "best_repeated"))]
    return reduce(DataFrame.union, twice, one).groupBy("problem").agg(F.count("*").alias("n"))


def capability_matrix(runs: DataFrame, more: Mapping[str, Column] | None = None, threshold: float = AVAILABLE) -> DataFrame:
    """(method_name, n_runs, n_success, capabilities) by the share of rows that provide each (PF-25)."""
    ok = F.col("status") == "success"
    among = lambda c: F.coalesce(F.avg(F.when(ok, c.cast("double"))) >= threshold, F.lit(False))
    unit = runs.groupBy(*UNIT).agg(F.countDistinct("view_id").alias("v"), F.bool_and(F.col("runtime_sec").isNotNull()).alias("timed"))
    by_unit = unit.groupBy("method_name").agg((F.avg((F.col("v") >= len(VIEWS)).cast("double")) >= threshold).alias("three_views"), (F.avg(F.col("timed").cast("double")) >= threshold).alias("all_view_runtime"))
    per = runs.groupBy("method_name").agg(
        F.count("*").alias("n_runs"), F.count_if(ok).alias("n_success"), (F.avg((F.col("status") != "missing").cast("double")) >= threshold).alias("raw_result"), among(F.col("ari").isNotNull()).alias("external_ari"),
        among(F.col("selected_k").isNotNull()).alias("selected_k"), among(F.col("true_k").isNotNull()).alias("true_k"), (F.avg(F.col("runtime_sec").isNotNull().cast("double")) >= threshold).alias("runtime"),
        *(among(c).alias(name) for name, c in (more or {}).items()),
    )
    return per.join(by_unit, "method_name")


def preflight(matrix: DataFrame, methods: Sequence[str], analyses: Sequence[str]) -> DataFrame:
    """(analysis, method_name, supported, reason): methods that can take part, with what the others lack (PF-26)."""
    known = set(matrix.columns)
    lacks = lambda c: F.when(~F.coalesce(F.col(c), F.lit(False)) if c in known else F.lit(True), F.lit(c))
    parts = F.explode(F.array(*(F.struct(F.lit(a).alias("analysis"), F.array_join(F.array_compact(F.array(*map(lacks, REQUIREMENTS[a]))), ";").alias("reason")) for a in analyses))).alias("x")
    asked = matrix.sparkSession.createDataFrame([(m,) for m in methods], "method_name string")
    return asked.join(matrix, "method_name", "left").select(parts, "method_name").select("x.analysis", "method_name", (F.col("x.reason") == "").alias("supported"), "x.reason")


def resolve_placeholders(node, index: Mapping[str, str]):
    """A declaration with each '@representative:<id>' replaced by the frozen method, lists and mappings too (PF-29)."""
    mark = "@representative:"
    if isinstance(node, str) and node.startswith(mark):
        return index[node[len(mark) :]]
    if isinstance(node, Mapping):
        return {k: resolve_placeholders(v, index) for k, v in node.items()}
    return [resolve_placeholders(v, index) for v in node] if isinstance(node, (list, tuple)) else node


def run_suite(runs: DataFrame, suite: Mapping, index: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """One declared comparison end to end (PF-28): its summary, virtual best, contrasts, representatives and checks.

    suite: {"methods": [...], "contrasts": [[gap_type, reference, comparison], ...], "scope": column}. Without index the
    placeholder 'global' is the method that representative() chooses.
    """
    best = best_view_frame(runs)
    if index is None:
        index = {"global": portfolio.representative(best).first().selected}
    plan = resolve_placeholders(suite, index)
    own = best.filter(F.col("method_name").isin(*plan["methods"]))
    vbs = portfolio.virtual_best(own)
    return {
        "summary": summarize_methods(own),
        "capabilities": preflight(capability_matrix(runs), plan["methods"], list(REQUIREMENTS)),
        "vbs": portfolio.vbs_summary(vbs),
        "gaps": gap_table(own, [tuple(c) for c in plan.get("contrasts", [])], [plan["scope"]] if plan.get("scope") else []),
        "representatives": portfolio.representative(own, [plan["scope"]] if plan.get("scope") else []),
        "problems": vbs_problems(vbs, own),
    }


def candidate_sources(included: DataFrame, excluded: DataFrame, registry: DataFrame) -> DataFrame:
    """Included and excluded ids with what the registry says of them (SET-04)."""
    both = included.select("metric_id", F.lit(True).alias("included")).union(excluded.select("metric_id", F.lit(False)))
    return both.join(registry, "metric_id", "left")


def representative_frame(best: DataFrame, scope: str = "family") -> DataFrame:
    """Rows of each family's chosen method, put together as one virtual method (SET-05)."""
    chosen = portfolio.representative(best, [scope]).select(scope, F.col("selected").alias("method_name"))
    return best.join(chosen, [scope, "method_name"]).withColumn("representative_id", F.concat(F.lit(f"{scope}:"), F.col(scope).cast("string")))


def ordered_summary(runs: DataFrame, keys: Sequence[str], by_mean: bool = False) -> DataFrame:
    """The summary block in report order: groups, then method, or the best mean first (SET-01, SET-02). A report is small."""
    first = [k for k in keys if k != "method_name"]
    last = [F.desc_nulls_last("ari_mean"), F.col("method_name")] if by_mean else [F.col("method_name")]
    return summarize_by(runs, keys).orderBy(*first, *(c for c in last if by_mean or "method_name" in keys))
