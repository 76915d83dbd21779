"""A repository of datasets on any store: folder index, features, utilities, runs, records and the training table.

Layout: <family>/subfamilies/<subfamily>/<dataset>/ with points.csv, labels.csv, metadata.json,
features/features_records.csv, utility/<view>/utility_vector.json, results/<method>/<view>.json.
Folders are listed by Spark's readers, so any store works and the driver holds no list of files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nullsafe import number
from ..operators.frames import expected_grid

PLACE = r"([^/]+)/subfamilies/([^/]+)/([^/]+)/"
FEATURES, UTILITIES, RUNS, META = "features/features_records.csv", "utility_vector.json", "*.json", "metadata.json"
STATES = ("PENDING", "RUNNING", "FAILED", "COMPLETE")


def located(df: DataFrame, path: Column | None = None) -> DataFrame:
    """df with family, subfamily and dataset_id from its files' paths."""
    where = path if path is not None else F.input_file_name()
    return df.withColumns({name: F.regexp_extract(where, PLACE, i) for i, name in enumerate(("family", "subfamily", "dataset_id"), 1)})


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def dataset_index(spark: SparkSession, root: str) -> DataFrame:
    """(family, subfamily, dataset_id, path) of every folder with a features file (SRC-07, SRC-14)."""
    found = _listed(spark, root, "features_records.csv").select("path").filter(F.endswith("path", F.lit("/" + FEATURES)))
    return located(found, F.col("path")).withColumn("path", F.regexp_replace("path", "/" + FEATURES + "$", ""))


def partition_folders(spark: SparkSession, root: str, name: str = "records.parquet") -> DataFrame:
    """(folder) of every partition that holds the named table (SRC-16); a table may be a file or a folder of parts."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").filter(F.col("path").contains(f"/{name}"))
    return found.select(F.regexp_extract("path", f"^(.*)/{name.replace('.', '[.]')}(/.*)?$", 1).alias("folder")).distinct()


def feature_rows(spark: SparkSession, root: str) -> DataFrame:
    """Feature records of all datasets, a row a dataset and view (view_mode becomes view_id)."""
    read = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "features_records.csv").csv(root)
    kept = [c for c in read.columns if c not in ("dataset_id", "family", "subfamily", "view_mode")]
    placed = located(read.withColumnRenamed("view_mode", "view_id"))
    return placed.select("family", "subfamily", "dataset_id", "view_id", *kept)


def feature_vector(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dataset_id, view_id, features): numbers in the requested order, NULL for what is missing or no number (SRC-05)."""
    cell = lambda c: number(F.col(c)) if c in rows.columns else F.lit(None).cast("double")
    return rows.select("dataset_id", "view_id", F.array(*map(cell, columns)).alias("features"))


def utility_rows(spark: SparkSession, root: str, prefix: str = "utility__") -> DataFrame:
    """(family, subfamily, dataset_id, view_id, metric_id, utility) of all utility vectors, prefixes dropped (SRC-06)."""
    schema = "utilities map<string,double>"
    read = located(spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", UTILITIES).json(root))
    view = F.regexp_extract(F.input_file_name(), r"/utility/([^/]+)/", 1)
    long = read.select("family", "subfamily", "dataset_id", view.alias("view_id"), F.explode("utilities").alias("metric_id", "utility"))
    return long.withColumn("metric_id", F.regexp_replace("metric_id", f"^{prefix}", ""))


def training_rows(features: DataFrame, utilities: DataFrame, metrics: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(feature rows with a utility__ column a metric, missing artifacts with their reason) (SRC-15, SET-11)."""
    keys = ["dataset_id", "view_id"]
    wide = utilities.groupBy(*keys).pivot("metric_id", list(metrics)).agg(F.first("utility"))
    wide = wide.select(*keys, *(F.col(m).alias(f"utility__{m}") for m in metrics))
    return features.join(wide, keys), features.join(wide, keys, "left_anti").select("family", "subfamily", *keys, F.lit(f"{UTILITIES} missing").alias("reason"))


def column_roles(columns: Sequence[str], ids: Sequence[str], prefix: str = "utility__") -> dict[str, list[str]]:
    """Names of the id, feature and target columns of the training table, in their order."""
    targets = [c for c in columns if c.startswith(prefix)]
    return {"ids": [c for c in columns if c in ids], "targets": targets, "features": [c for c in columns if c not in ids and c not in targets]}


def unified_table(table: DataFrame, splits: DataFrame, ids: Sequence[str], n_features: int | None = None, n_targets: int | None = None, prefix: str = "utility__") -> DataFrame:
    """The training table with numbers as doubles and its split (SRC-12, SRC-13).

    Other numbers of feature or target columns than expected, and datasets
    without a split, are errors: nothing is dropped silently.
    """
    roles = column_roles(table.columns, ids, prefix)
    for kind, n in (("features", n_features), ("targets", n_targets)):
        if n is not None and len(roles[kind]) != n:
            raise ValueError(f"{len(roles[kind])} {kind}, expected {n}")
    text = {c for c, t in table.dtypes if t == "string"}
    cell = lambda c: number(F.col(c)).alias(c) if c in text else F.col(c).cast("double").alias(c)
    shaped = table.select(*roles["ids"], *map(cell, roles["features"] + roles["targets"]))
    met = shaped.join(splits.select("dataset_id", "split_id"), "dataset_id", "left")
    if met.filter("split_id is null").limit(1).count():
        raise ValueError("datasets without a split")
    return met


def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """(points with y_true, metadata) of one dataset folder (SRC-04). Points and labels meet by row number, which both files carry in point_id."""
    points = spark.read.option("header", True).csv(f"{folder}/points.csv")
    labels = spark.read.option("header", True).csv(f"{folder}/labels.csv")
    met = points.join(labels, "point_id", "left")
    shaped = met.select(F.col("point_id").cast("long").alias("point_id"), number(F.col("x")).alias("x"), number(F.col("y")).alias("y"), F.col("y_true").cast("int").alias("y_true"))
    text = spark.read.option("wholetext", True).text(f"{folder}/{META}").first()
    return shaped, json.loads(text.value) if text else {}


def collect_runs(spark: SparkSession, root: str, schema: str = "status string, ari double, runtime_sec double, selected_k int, true_k int") -> DataFrame:
    """Run rows of all result files; cells of the grid without a file are rows of status 'missing' (SRC-09)."""
    read = located(spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", RUNS).json(root))
    where = F.input_file_name()
    own = read.withColumns({"method_name": F.regexp_extract(where, r"/results/([^/]+)/", 1), "view_id": F.regexp_extract(where, r"/results/[^/]+/([^/]+)[.]json$", 1)}).filter("method_name <> ''")
    return expected_grid(own).join(own, ["dataset_id", "method_name", "view_id"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def wide_trials(log: DataFrame, keys: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """One row a trial with '<metric> (w=<weight>)' and '<metric>_norm' columns (SRC-25). log: keys, metric_id, raw, norm."""
    at = lambda m, c: F.max(F.when(F.col("metric_id") == m, F.col(c)))
    return log.groupBy(*keys).agg(*(x for m, w in weights.items() for x in (at(m, "raw").alias(f"{m} (w={w})"), at(m, "norm").alias(f"{m}_norm"))))


class IntegrityError(ValueError):
    """A finished record contradicts itself or the provenance asked for."""


class ResultStore:
    """Records by layer and key as appended Parquet rows; COMPLETE ones are final and reused only with their provenance (SRC-28).

    The newest row of a key counts, unless a COMPLETE one exists. Hashes are of
    sorted JSON, so the order of fields plays no part.
    """

    SCHEMA = "layer string, key string, state string, provenance string, content string, provenance_hash string, content_hash string, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def canonical(value: Mapping) -> str:
        return json.dumps(value, sort_keys=True, separators=(",", ":"))

    def rows(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def current(self) -> DataFrame:
        order = Window.partitionBy("layer", "key").orderBy((F.col("state") == "COMPLETE").desc(), F.desc("seq"))
        return self.rows().withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")

    def load(self, layer: str, key: str):
        return self.current().filter((F.col("layer") == layer) & (F.col("key") == key)).first()

    def put(self, layer: str, key: str, state: str, provenance: Mapping | None = None, content: Mapping | None = None) -> None:
        """Append a record; a finished one is never replaced."""
        if state not in STATES:
            raise ValueError(f"unknown state: {state!r}")
        before = self.load(layer, key)
        if before and before.state == "COMPLETE":
            raise IntegrityError(f"{layer}/{key} is complete")
        texts = [self.canonical(x or {}) for x in (provenance, content)]
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        row = (layer, key, state, *texts, *hashes, (before.seq + 1) if before else 0)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def reuse(self, layer: str, key: str, provenance: Mapping):
        """The content of a finished record of the same provenance, None where there is no finished one; anything else is an error."""
        found = self.load(layer, key)
        if not found or found.state != "COMPLETE":
            return None
        for text, digest in ((found.provenance, found.provenance_hash), (found.content, found.content_hash)):
            if hashlib.sha256(text.encode()).hexdigest() != digest:
                raise IntegrityError(f"{layer}/{key}: hash mismatch")
        if found.provenance != self.canonical(provenance):
            raise IntegrityError(f"{layer}/{key}: other provenance")
        return json.loads(found.content)
