"""Bounded samples of labelled rows, chosen by the hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_STEPS = 1 << 30


def order(column: str = "id"):
    """The order in which ids are taken: by hash, then by id; equal at every run."""
    return F.xxhash64(F.lit(17), column), F.col(column)


def sampled_ids(labelled: DataFrame, bound: int, total: int | None = None) -> DataFrame:
    """At most ``bound`` ids of each label, and at most ``total`` in all, from ``id, label``: those that come first by hash.

    An id with several labels counts for the smallest.
    """
    single = labelled.groupBy("id").agg(F.min("label").alias("label"))
    counts = single.groupBy("label").agg(F.count("*").alias("n")).collect()  # a row for each label
    if total is not None and counts:
        bound = max(1, min(bound, total // len(counts)))
    # A threshold leaves a few more than the bound for the ranking.
    position, chosen = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(_STEPS)), F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col("label") == F.lit(r["label"])) & (position < F.lit(min(_STEPS, (bound + bound // 4 + 16) * _STEPS // r["n"]))))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(position, *order()))
    return single.where(chosen).withColumn("__rank", rank).where(F.col("__rank") <= bound).select("id", "label")
