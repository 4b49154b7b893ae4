"""Run query texts on a graph."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.graph import Graph
from lodegraph.plans.emit import emit
from lodegraph.plans.model import SimPattern
from lodegraph.plans.normalize import normalize
from lodegraph.plans.parser import parse
from lodegraph.plans.planner import pattern_order
from lodegraph.plans.strategies import post_filter, semi_join_reduced
from lodegraph.sources import text as text_files

STRATEGIES = ("flat", "postfilter", "semijoin")


class QueryTimeout(RuntimeError):
    """The query did not end in time; there are no partial results."""


class Engine:
    def __init__(self, graph: Graph):
        self.graph = graph

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        return cls(Graph.load(spark, path))

    def query(self, text: str, select: list[str] | None = None, limit: int | None = None, ordered: bool = False, strategy: str = "flat", order: str = "cost", strict: bool = False) -> DataFrame:
        """The result of a query as a DataFrame with a column for each variable, in order of first appearance."""
        query = normalize(parse(text))
        if strategy == "postfilter":
            df = post_filter(self.graph, query, strict)
        elif strategy == "semijoin":
            df = semi_join_reduced(self.graph, query, strict)
        elif strategy == "flat":
            df = emit(self.graph, query, pattern_order(query, self.graph.statistics, order), strict)
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
        if select is not None:
            df = df.select(*(F.col(f"`{v}`") for v in select)).distinct()
        if ordered:
            df = df.orderBy(*(F.col(f"`{v}`") for v in df.columns))
        return df if limit is None else df.limit(limit)

    def collect(self, text: str, timeout: float = 600.0, **options) -> list:
        """Rows of a query; cancelled and reported as :class:`QueryTimeout` after ``timeout`` seconds."""
        with self._in_time(text, timeout):
            return self.query(text, **options).collect()

    def count(self, text: str, timeout: float = 600.0, **options) -> int:
        """Number of rows of a query; none of them reaches the driver."""
        with self._in_time(text, timeout):
            return self.query(text, **options).count()

    @contextlib.contextmanager
    def _in_time(self, text: str, timeout: float):
        """Jobs within are cancelled after ``timeout`` seconds, those that have not begun by then included."""
        sc = self.graph.triples.sparkSession.sparkContext
        group, late = f"query-{uuid.uuid4().hex}", threading.Event()
        before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}

        def cancel():
            late.set()
            sc._jsc.sc().cancelJobGroupAndFutureJobs(group)

        timer = threading.Timer(timeout, cancel)
        sc.setJobGroup(group, text, True)
        timer.start()
        try:
            yield
        except Exception as e:
            if late.is_set():
                raise QueryTimeout(f"more than {timeout} s: {text}") from e
            raise
        finally:
            timer.cancel()
            for k, v in before.items():
                sc.setLocalProperty(k, v)
        if late.is_set():
            raise QueryTimeout(f"more than {timeout} s: {text}")

    def counts(self, texts: list[str]) -> DataFrame:
        """``query_no, n`` of a batch of queries, as one plan."""
        parts = [self.query(t).agg(F.count("*").alias("n")).select(F.lit(i).cast("int").alias("query_no"), "n") for i, t in enumerate(texts, 1)]
        return reduce(DataFrame.unionByName, parts)

    def run_file(self, path: str, timeout: float = 600.0, limit: int | None = None, sink=None) -> list[tuple[int, int | None, int]]:
        """``(query number, results, nanoseconds)`` of every line of a query file; planning is timed, loading is not.

        Results are counted where they are. A query that takes longer than ``timeout`` has no number of results. Each line
        goes to ``sink``, a text file open for writing, as ``number;results;nanoseconds`` when it is known.
        """
        found = []
        for number, line in text_files.read_queries(path):
            start = time.perf_counter_ns()
            try:
                n = self.count(line, timeout, limit=limit)
            except QueryTimeout:
                n = None
            found.append((number, n, time.perf_counter_ns() - start))
            if sink is not None:
                print(text_files.stats_line(*found[-1]), file=sink, flush=True)
        return found

    def describe(self, text: str, order: str = "cost") -> str:
        """The query's patterns, its planned order and Spark's plan."""
        query = parse(text)
        normal = normalize(query)
        patterns = pattern_order(normal, self.graph.statistics, order)
        df = emit(self.graph, normal, patterns)
        lines = ["patterns:", *(f"  {_shown(p)}" for p in query.patterns), "order:", *(f"  {_shown(p)}" for p in patterns)]
        return "\n".join([*lines, "plan:", df._jdf.queryExecution().toString()])


def _shown(p) -> str:
    term = lambda t: f"?{t.name}" if hasattr(t, "name") else str(t.value)
    if hasattr(p, "p"):
        return f"{term(p.s)} {term(p.p)} {term(p.o)}"
    if isinstance(p, SimPattern):
        return f"{term(p.s)} k{p.k} {term(p.o)}"
    return f"{term(p.s)} k{p.forward} {term(p.o)}" + (f" . {term(p.o)} k{p.backward} {term(p.s)}" if p.backward else "")


__all__ = ["STRATEGIES", "Engine", "QueryTimeout"]
