"""Equal patterns once; the similarity clauses of a pair of terms fused into one."""

from __future__ import annotations

from lodegraph.plans.model import PairPattern, Query, SimPattern


def normalize(query: Query) -> Query:
    """Same-direction clauses of a pair hold together, so the smaller k decides; opposite ones become a mutual clause."""
    ranks: dict[tuple, int] = {}
    for p in query.patterns:
        if isinstance(p, SimPattern):
            ranks[p.s, p.o] = min(p.k, ranks.get((p.s, p.o), p.k))
    found: dict = {}
    for p in query.patterns:
        if not isinstance(p, SimPattern):
            found[p] = None
        elif (p.s, p.o) in ranks:
            forward = ranks.pop((p.s, p.o))
            found[PairPattern(p.s, p.o, forward, ranks.pop((p.o, p.s), 0))] = None
    return Query(tuple(found))
