"""Readers and writers of point clouds, records and trial logs."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullsafe import number

MISSING = ("", "?", "NaN", "nan")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV, JSON or ORC by extension (SRC-21, SRC-22)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    return reader.orc(path) if kind == "orc" else reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, CSV or JSON by extension, through Spark's commit protocol (SRC-19, SRC-20, SRC-23, SRC-24, SRC-27)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "jsonl"):
        writer.json(path)
    else:
        writer.parquet(path)


def read_cloud_csv(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """Points of a CSV: columns x and y, else the first two; other values than numbers become NULL (SRC-01).

    point_id follows the file and row order within a partition.
    """
    raw = spark.read.option("header", True).csv(path)
    names = ["x", "y"] if {"x", "y"} <= set(raw.columns) else raw.columns[:2]
    return raw.select(F.lit(dataset_id).alias("dataset_id"), F.monotonically_increasing_id().alias("point_id"), *(number(F.col(f"`{c}`")).alias(n) for c, n in zip(names, ("x", "y"), strict=True)))


def read_cloud_npy(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """Points of .npy files, read as binary so that any store works (SRC-01). A file is one row of a task."""

    def run(batches):
        import io

        for batch in batches:
            for content in batch["content"]:
                x = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"dataset_id": dataset_id, "point_id": np.arange(len(x)), "x": x[:, 0].astype(float), "y": x[:, 1].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "dataset_id string, point_id long, x double, y double")


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an ARFF file with the declared attribute names; numeric ones as doubles (SRC-29).

    The header is small and read first; data lines are split by the executors.
    Quoted values with commas are not supported.
    """
    lines = spark.read.text(path).withColumn("line", F.trim("value")).filter("line <> '' and not startswith(line, '%')")
    head = lines.filter(F.startswith(F.lower("line"), F.lit("@attribute"))).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    names, numeric = [], []
    for r in head:
        _, name, kind = r.line.split(None, 2)
        names.append(name.strip("'\""))
        numeric.append(kind.split()[0].lower() in ("numeric", "real", "integer"))
    cells = F.split("line", r"\s*,\s*")
    data = lines.filter(~F.startswith("line", F.lit("@"))).select(cells.alias("c"))
    clean = lambda c: F.when(~c.isin(*MISSING), c)
    return data.select(*((number(F.col("c")[i]) if num else clean(F.col("c")[i])).alias(n) for i, (n, num) in enumerate(zip(names, numeric, strict=True))))


def parse_weights(c: Column | str) -> Column:
    """A {metric: weight} cell (SRC-10)."""
    return F.from_json(c, "map<string,double>")


def parse_names(c: Column | str) -> Column:
    """A list of names as JSON, or separated by commas or semicolons (SRC-11)."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(c, "array<string>"), plain)


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, total, mixed, schema): a content hash without regard to row order (SRC-18)."""
    h = F.xxhash64(*df.columns)
    kinds = json.dumps(sorted(df.dtypes))
    return df.agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("total"), F.bit_xor(h).alias("mixed")).withColumn("schema", F.sha2(F.lit(kinds), 256))


def merge_tables(frames: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """Rows of equally shaped tables, after a check of their schemas (SRC-17)."""
    first, *rest = frames
    for other in rest:
        if strict and sorted(other.dtypes) != sorted(first.dtypes):
            raise ValueError(f"tables differ: {sorted(set(first.dtypes) ^ set(other.dtypes))}")
        first = first.unionByName(other, allowMissingColumns=not strict)
    return first


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows (SET-12)."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def last_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by key in which new rows replace old ones (SET-13)."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def pending(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that has no COMPLETE record yet (SRC-28, JOIN-13)."""
    return expected.join(done.filter("state = 'COMPLETE'"), list(keys), "left_anti")


def assert_label_free(df: DataFrame, forbidden: Sequence[str] = ("ari", "nmi", "ami", "y_true", "cluster_id")) -> DataFrame:
    """df, unless its schema, nested fields too, carries an evaluation column (FLT-17 to FLT-20)."""

    def names(kind: T.DataType) -> set[str]:
        if isinstance(kind, T.StructType):
            return set().union(*({f.name.lower()} | names(f.dataType) for f in kind)) if kind.fields else set()
        if isinstance(kind, T.ArrayType):
            return names(kind.elementType)
        return names(kind.valueType) if isinstance(kind, T.MapType) else set()

    if found := names(df.schema) & set(forbidden):
        raise ValueError(f"ground truth in the input: {sorted(found)}")
    return df


def prepare(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with x and y: constant columns dropped, medians imputed, standardised, two principal components unless already 2-D (SRC-30).

    The sign of a component is that of its largest loading.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..operators.neighbours import scale, scaler

    spread = rows.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    kept = [c for c in columns if spread[c] and spread[c] > 1e-12]
    scaled = scale(rows, scaler(rows, kept), kept)
    if len(kept) <= 2:
        at = lambda i: F.col("features")[i] if i < len(kept) else F.lit(0.0)
        return scaled.withColumns({"x": at(0), "y": at(1)}).drop("features")
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors := scaled.withColumn("_v", array_to_vector("features")))
    loads = model.pc.toArray()
    sign = [1.0 if loads[np.abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in (0, 1)]
    out = model.transform(vectors).withColumn("_a", vector_to_array("_p"))
    return out.withColumns({"x": F.col("_a")[0] * sign[0], "y": F.col("_a")[1] * sign[1]}).drop("features", "_v", "_p", "_a")
