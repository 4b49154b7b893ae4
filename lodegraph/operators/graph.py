"""The graph: triples, neighbour lists and statistics; written once, read by every query.

A written graph holds every order that a pattern can be bound in, so that constants prune files and row groups: triples by
predicate, by subject and by object; neighbour lists by source and by target, and the mutual neighbours with both ranks.
Statistics are written with it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import knn as knn_ops
from lodegraph.operators import stats
from lodegraph.plans.planner import Statistics

TRIPLES = "s long, p long, o long"
KNN = "src long, dst long, rank int"
MUTUAL = "src long, dst long, rank_fwd int, rank_bwd int"
_PREDICATES = "p long, n long, n_s long, n_o long"
_LISTS = "max_k int, nodes long, n_edges long"


class Graph:
    def __init__(self, triples: DataFrame, knn: DataFrame, distinct: bool = False):
        """Triples are made distinct once, here, so that every join is free of duplicates."""
        triples = triples.select(*(F.col(c).cast("long").alias(c) for c in ("s", "p", "o")))
        knn = knn.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("rank").cast("int").alias("rank"))
        self.triples = triples if distinct else triples.dropDuplicates(["s", "p", "o"])
        self.knn = knn if distinct else knn.groupBy("src", "dst").agg(F.min("rank").alias("rank"))
        # Other orders of the same rows, where they have been written.
        self.by_subject = self.by_object = self.triples
        self.knn_by_target = self.knn
        self.mutual: DataFrame | None = None
        self._written: tuple[DataFrame, DataFrame] | None = None

    @cached_property
    def statistics(self) -> Statistics:
        """A row for each predicate and one for the kNN graph."""
        predicates, lists = self._written or self._counted()
        rows, k = predicates.collect(), lists.first()
        return Statistics(sum(r["n"] for r in rows), {r["p"]: (r["n"], r["n_s"], r["n_o"]) for r in rows}, k["nodes"] or 1, k["max_k"] or 0)

    def _counted(self) -> tuple[DataFrame, DataFrame]:
        return stats.by_predicate(self.triples, approximate=True), stats.of_knn(self.knn)

    @property
    def max_k(self) -> int:
        return self.statistics.max_k

    def save(self, path: str) -> None:
        """Every copy is dealt out by ranges of its order, so that a hot predicate or object spreads over many tasks, a task
        writes a few folders only, and files hold short ranges of ids."""

        def ordered(df: DataFrame, *columns: str) -> DataFrame:
            return df.repartitionByRange(*columns).sortWithinPartitions(*columns)

        ordered(self.triples, "p", "o", "s").write.partitionBy("p").parquet(f"{path}/triples")
        spark = self.triples.sparkSession
        triples = spark.read.schema("s long, o long, p long").parquet(f"{path}/triples").select("s", "p", "o")
        ordered(triples, "s", "p", "o").write.parquet(f"{path}/by_subject")
        ordered(triples, "o", "p", "s").write.parquet(f"{path}/by_object")
        ordered(self.knn, "src", "rank").write.parquet(f"{path}/knn")
        knn = spark.read.schema(KNN).parquet(f"{path}/knn")
        ordered(knn, "dst", "rank", "src").write.parquet(f"{path}/knn_by_target")
        ordered(knn_ops.fused(knn), "src", "dst").write.parquet(f"{path}/mutual")
        predicates, lists = Graph(triples, knn, distinct=True)._counted()
        predicates.write.parquet(f"{path}/predicates")
        lists.write.parquet(f"{path}/lists")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        def read(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{path}/{name}")

        graph = cls(read("triples", "s long, o long, p long"), read("knn", KNN), distinct=True)
        graph.by_subject, graph.by_object = read("by_subject", TRIPLES), read("by_object", TRIPLES)
        graph.knn_by_target, graph.mutual = read("knn_by_target", KNN), read("mutual", MUTUAL)
        graph._written = read("predicates", _PREDICATES), read("lists", _LISTS)
        return graph
