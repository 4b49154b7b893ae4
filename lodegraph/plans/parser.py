"""Query text to patterns.

Patterns are separated by ``.``, terms by white space. A term is ``?name``, a
non-negative integer or, in the middle, ``kN`` (similarity) or ``bN`` (best;
runs as k = 1, and all of a query's ``bN`` must agree).
"""

from __future__ import annotations

import re

from lodegraph.plans.model import Const, Query, SimPattern, Term, TriplePattern, Var

_MIDDLE = re.compile(r"([kb])(\d+)")


class QuerySyntaxError(ValueError):
    pass


def _term(text: str, at: int) -> Term:
    if text.startswith("?") and len(text) > 1:
        return Var(text[1:])
    if text.isascii() and text.isdigit():
        return Const(int(text))
    raise QuerySyntaxError(f"pattern {at}: not a term: {text!r}")


def parse(text: str) -> Query:
    patterns = []
    for at, part in enumerate(text.split("."), 1):
        terms = part.split()
        if not terms:
            continue
        if len(terms) != 3:
            raise QuerySyntaxError(f"pattern {at}: three terms expected, found {len(terms)}")
        first, middle, last = terms
        if m := _MIDDLE.fullmatch(middle):
            n = int(m[2])
            best = n if m[1] == "b" else 0
            patterns.append(SimPattern(_term(first, at), _term(last, at), 1 if best else n, best))
        else:
            patterns.append(TriplePattern(_term(first, at), _term(middle, at), _term(last, at)))
    if not patterns:
        raise QuerySyntaxError("no pattern")
    if len({p.best for p in patterns if isinstance(p, SimPattern) and p.best}) > 1:
        raise QuerySyntaxError("Incorrect query")
    return Query(tuple(patterns))


def parse_lines(lines) -> list[tuple[int, str]]:
    """Numbered non-empty lines of a query file."""
    return list(enumerate((line.strip() for line in lines if line.strip()), 1))
