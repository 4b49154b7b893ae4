"""An ordered query as one flat DataFrame join that Catalyst and AQE plan further."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.model import Const, PairPattern, Pattern, Query, TriplePattern, Var

_log = logging.getLogger(__name__)


def scan(graph, pattern: Pattern, at: int, strict: bool = False) -> DataFrame:
    """The rows of one pattern, with columns of its own for its variables: constants and repeats become filters."""
    if isinstance(pattern, TriplePattern):
        df, columns = triples(graph, pattern), dict(pattern.terms)
    else:
        df, columns = neighbours(graph, pattern, strict), dict(pattern.terms)
    first: dict[str, str] = {}
    for column, term in columns.items():
        if isinstance(term, Const):
            df = df.where(F.col(column) == F.lit(term.value))
        elif term.name in first:
            df = df.where(F.col(first[term.name]) == F.col(column))
        else:
            first[term.name] = column
    if not first:
        return df.select(F.lit(1).alias(f"__{at}")).limit(1)
    return df.select(*(F.col(c).alias(f"__{at}_{v}") for v, c in first.items()))


def triples(graph, p: TriplePattern) -> DataFrame:
    """The copy of the triples that the pattern's constants prune best."""
    if isinstance(p.p, Const):
        return graph.triples
    return graph.by_subject if isinstance(p.s, Const) else graph.by_object if isinstance(p.o, Const) else graph.triples


def neighbours(graph, p: PairPattern, strict: bool = False) -> DataFrame:
    """``src, dst`` of a similarity clause, one-directional or mutual."""
    most = max(p.forward, p.backward)
    if graph.max_k is not None and most > graph.max_k:
        if strict:
            raise ValueError(f"k = {most} is larger than the graph's {graph.max_k}")
        _log.warning("k = %d is larger than the graph's %d: no result", most, graph.max_k)
        return graph.knn.where(F.lit(False)).select("src", "dst")
    if p.backward and graph.mutual is not None:
        return graph.mutual.where((F.col("rank_fwd") <= F.lit(p.forward)) & (F.col("rank_bwd") <= F.lit(p.backward))).select("src", "dst")
    lists = graph.knn_by_target if isinstance(p.o, Const) and not isinstance(p.s, Const) else graph.knn
    forward = lists.where(F.col("rank") <= F.lit(p.forward)).select("src", "dst")
    if not p.backward:
        return forward
    backward = graph.knn.where(F.col("rank") <= F.lit(p.backward)).select(F.col("dst").alias("__s"), F.col("src").alias("__d"))
    return forward.join(backward, (F.col("src") == F.col("__s")) & (F.col("dst") == F.col("__d")), "left_semi")


def project(df: DataFrame, query: Query, bound: dict[str, str]) -> DataFrame:
    if not query.variables:
        return df.select(F.lit(1).alias("matched")).limit(1)
    return df.select(*(F.col(f"`{bound[v]}`").alias(v) for v in query.variables))


def emit(graph, query: Query, patterns: list[Pattern], strict: bool = False) -> DataFrame:
    """Natural join with set semantics (triples and neighbours hold no duplicates), all variables projected."""
    df: DataFrame | None = None
    bound: dict[str, str] = {}
    for at, pattern in enumerate(patterns):
        rows = scan(graph, pattern, at, strict)
        own = dict.fromkeys(t.name for _, t in pattern.terms if isinstance(t, Var))
        if df is None:
            df = rows
        else:
            on: Column | None = None
            for v in own:
                if v in bound:
                    same = F.col(f"`{bound[v]}`") == F.col(f"`__{at}_{v}`")
                    on = same if on is None else on & same
            df = df.crossJoin(rows) if on is None else df.join(rows, on)
        for v in own:
            bound.setdefault(v, f"__{at}_{v}")
    return project(df, query, bound)
