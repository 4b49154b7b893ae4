"""Connected components of a stored edge table: min-label hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` with the smallest node that each node reaches, from ``a, b``; every node of an edge appears."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        sent = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        lower = labels.unionByName(sent).groupBy("node").agg(F.min("label").alias("low"))
        # What a node learns, the node that it points at learns as well.
        hooked = labels.join(lower, "node").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("low"))
        merged = lower.unionByName(hooked).groupBy("node").agg(F.min("low").alias("low"))
        target = merged.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        jumped = merged.join(target, "low", "left").select("node", F.coalesce("lower", "low").alias("label"))
        changed = stored(
            jumped.join(labels.withColumnRenamed("label", "old"), "node").select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "labels"
        )
        labels = changed.select("node", "label")
        if changed.where("moved").isEmpty():
            return labels
