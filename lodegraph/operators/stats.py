"""Counts for the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_predicate(triples: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows and distinct subjects and objects of each predicate.

    The exact form counts distinct values in two aggregations, so a predicate that
    fills a third of the table is spread over all tasks; the approximate form is a
    single pass of sketches, which is what the planner uses.
    """
    if approximate:
        return triples.groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("n_s"), F.approx_count_distinct("o").alias("n_o"))
    rows = triples.groupBy("p").agg(F.count("*").alias("n"))
    s = triples.groupBy("p", "s").count().groupBy("p").agg(F.count("*").alias("n_s"))
    o = triples.groupBy("p", "o").count().groupBy("p").agg(F.count("*").alias("n_o"))
    return rows.join(s, "p").join(o, "p")


def of_graph(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count("*").alias("n_triples"), F.max("s").alias("max_s"), F.max("p").alias("max_p"), F.max("o").alias("max_o"))


def of_knn(knn: DataFrame) -> DataFrame:
    lists = knn.groupBy("src").agg(F.max("rank").alias("longest"), F.count("*").alias("n"))
    return lists.agg(F.max("longest").alias("max_k"), F.count("*").alias("nodes"), F.sum("n").alias("n_edges"))
