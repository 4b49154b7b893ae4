"""Other ways to run a query: pattern first and similarity after it, and semi-join reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.emit import emit, neighbours, project, scan
from lodegraph.plans.model import Const, PairPattern, Query, TriplePattern, Var, variables_of
from lodegraph.plans.planner import pattern_order


def post_filter(graph, query: Query, strict: bool = False) -> DataFrame:
    """Triples first; then clause after clause: filter (both ends bound), expand (one end bound), product (none)."""
    triples = Query(tuple(p for p in query.patterns if isinstance(p, TriplePattern)))
    rest = [p for p in query.patterns if isinstance(p, PairPattern)]
    bound = {v: v for v in triples.variables}
    df = emit(graph, triples, pattern_order(triples, graph.statistics), strict) if triples.patterns else None

    def urgency(p):
        ends = [t for _, t in p.terms]
        is_bound = [isinstance(t, Const) or t.name in bound for t in ends]
        shared = sum(1 for q in rest if variables_of(q) & variables_of(p))
        return (not all(is_bound), not is_bound[0], not is_bound[1], -shared)

    while rest:
        p = min(rest, key=urgency)
        rest.remove(p)
        pairs = neighbours(graph, p, strict).select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
        fresh: dict[str, str] = {}
        on = None
        for column, t in (("__src", p.s), ("__dst", p.o)):
            if isinstance(t, Const):
                pairs = pairs.where(F.col(column) == F.lit(t.value))
            elif t.name in bound:
                same = F.col(f"`{t.name}`") == F.col(column)
                on = same if on is None else on & same
            elif t.name in fresh:
                pairs = pairs.where(F.col(column) == F.col(fresh[t.name]))
            else:
                fresh[t.name] = column
        if df is None:
            df = pairs
        elif not fresh and on is not None:
            df = df.join(pairs, on, "left_semi")
        elif on is not None:
            df = df.join(pairs, on)
        else:
            df = df.crossJoin(pairs)
        df = df.select(*(F.col(f"`{v}`") for v in bound), *(F.col(c).alias(v) for v, c in fresh.items()), *([F.lit(1).alias("matched")] if not bound and not fresh else []))
        bound |= {v: v for v in fresh}
    return project(df, query, bound)


def semi_join_reduced(graph, query: Query, strict: bool = False) -> DataFrame:
    """Cyclic similarity queries: neighbour lists lose rows whose ends no triple pattern can bind, then the flat join."""
    plans = []
    for at, p in enumerate(pattern_order(query, graph.statistics)):
        rows = scan(graph, p, at, strict)
        if isinstance(p, PairPattern):
            for v in variables_of(p):
                for i, q in enumerate(query.patterns):
                    if isinstance(q, TriplePattern) and v in variables_of(q) and any(isinstance(t, Const) for _, t in q.terms):
                        ends = scan(graph, q, 1000 + i, strict)
                        rows = rows.join(ends, F.col(f"`__{at}_{v}`") == F.col(f"`__{1000 + i}_{v}`"), "left_semi")
        plans.append((p, rows))
    df, bound = None, {}
    for at, (p, rows) in enumerate(plans):
        on = None
        own = dict.fromkeys(t.name for _, t in p.terms if isinstance(t, Var))
        for v in own:
            if v in bound:
                same = F.col(f"`{bound[v]}`") == F.col(f"`__{at}_{v}`")
                on = same if on is None else on & same
        df = rows if df is None else df.crossJoin(rows) if on is None else df.join(rows, on)
        for v in own:
            bound.setdefault(v, f"__{at}_{v}")
    return project(df, query, bound)
