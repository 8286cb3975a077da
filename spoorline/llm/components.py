"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (v, root): every vertex of an edge with the least vertex of its component.

    Every round takes the least label among the neighbours, map-side first, then the label's label; labels are a stored
    table, so that lineage doesn't grow. Rounds grow with the logarithm of a component's width. No edges: no rows.
    """
    both = saved(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", "root", F.least("root", "near").alias("low"))
        ahead = labels.select(F.col("v").alias("low"), F.col("root").alias("low_root"))
        moved = saved(lower.join(ahead, "low", "left").select("v", F.least("low", F.coalesce("low_root", "low")).alias("root"), (F.least("low", F.coalesce("low_root", "low")) < F.col("root")).alias("moved")), "labels")
        labels = moved.select("v", "root")
        if moved.where("moved").isEmpty():
            return labels
