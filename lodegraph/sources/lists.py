"""Neighbour lists from files of pairs, and of pairs with distances."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.knn import ranked
from lodegraph.operators.numbering import numbered
from lodegraph.sources.text import numbered_lines

_log = logging.getLogger(__name__)
#: A pair and its distance: ``('12#34', 0.5)``.
_DISTANCE = r"\('(\d+)#(\d+)',\s*([^)]*)\)"


def read_pairs(spark: SparkSession, path: str, nodes: DataFrame, k: int) -> DataFrame:
    """``src, dst, rank`` from lines of two terms, the neighbours of a term nearest first.

    Terms are encoded by the dictionary ``nodes`` (``id, term``); pairs with a term that
    it lacks are left out. Lists are cut after ``k``.
    """
    parts = F.split(F.trim("value"), r"\s+")
    pairs = numbered_lines(spark, path).where(F.size(parts) >= 2).select(parts[0].alias("a"), parts[1].alias("b"), "line")
    a, b = (nodes.select(F.col("term").alias(t), F.col("id").alias(i)) for t, i in (("a", "src"), ("b", "dst")))
    return ranked(pairs.join(a, "a").join(b, "b"), "src", ["line"], k).select("src", "dst", "rank")


def read_distances(spark: SparkSession, path: str, k: int) -> tuple[DataFrame, DataFrame]:
    """``src, dst, rank`` from lines ``('e1#e2', distance)``, and the dictionary ``id, entity``.

    Entities are numbered in order of first appearance. Each pair enters both lists in
    the order of the lines, as long as a list has fewer than ``k``; two lines of a pair
    are two entries.
    """
    found = [F.regexp_extract("value", _DISTANCE, i).cast("long") for i in (1, 2)]
    pairs = numbered_lines(spark, path).where(F.col("value").rlike(_DISTANCE)).select(found[0].alias("e1"), found[1].alias("e2"), "line")
    sides = pairs.select(F.col("e1").alias("entity"), F.col("e2").alias("other"), (2 * F.col("line")).alias("at")).unionByName(
        pairs.select(F.col("e2").alias("entity"), F.col("e1").alias("other"), (2 * F.col("line") + 1).alias("at"))
    )
    entities = numbered(sides.groupBy("entity").agg(F.min("at").alias("at")), ["at"]).select("id", "entity")
    lists = ranked(sides, "entity", ["at"], k)
    other = entities.select(F.col("id").alias("dst"), F.col("entity").alias("other"))
    return lists.join(entities.withColumnRenamed("id", "src"), "entity").join(other, "other").select("src", "dst", "rank"), entities


def padded(knn: DataFrame, k: int) -> DataFrame:
    """``src, list``: every list with exactly ``k`` entries, missing ones 0; short lists are reported."""
    lists = knn.where(F.col("rank") <= k).groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("l"))  # k entries at most
    short = lists.where(F.size("l") < k).count()
    if short:
        _log.warning("%d lists are shorter than k = %d", short, k)
    return lists.select("src", F.concat("l", F.array_repeat(F.lit(0).cast("long"), k - F.size("l"))).alias("list"))


def write_padded(knn: DataFrame, k: int, path: str) -> None:
    """A line for each list, by source."""
    padded(knn, k).orderBy("src").select(F.concat_ws(" ", F.col("list").cast("array<string>")).alias("value")).write.text(path)
