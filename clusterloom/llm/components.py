"""Connected components of an edge table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (u, v): component is the smallest node reachable.

    Minimum labels travel over the edges and are then shortened by pointer
    jumping, so the rounds grow with the logarithm of a component's diameter.
    Self loops and repeated edges are allowed; each round is a written table.
    """
    pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = materialize(pairs.filter("u is not null and v is not null").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        pulled = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = pulled.select(F.col("node").alias("via"), F.col("via").alias("further"))
        after = materialize(
            pulled.join(jump, "via", "left").select("node", "was", F.least("via", "further").alias("component")), "labels"
        )
        moved = after.filter("component < was").limit(1).count()
        discard(labels)
        labels = after.select("node", "component")
        labels._clusterloom_path = after._clusterloom_path
        if not moved:
            return labels
