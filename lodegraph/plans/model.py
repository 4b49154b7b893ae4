"""Queries as data: terms, triple patterns, similarity patterns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: int


Term = Var | Const


@dataclass(frozen=True)
class TriplePattern:
    s: Term
    p: Term
    o: Term

    @property
    def terms(self) -> tuple[tuple[str, Term], ...]:
        return (("s", self.s), ("p", self.p), ("o", self.o))


@dataclass(frozen=True)
class SimPattern:
    """``o`` is among the ``k`` nearest neighbours of ``s``; ``best`` if written as ``bN``."""

    s: Term
    o: Term
    k: int
    best: int = 0

    @property
    def terms(self) -> tuple[tuple[str, Term], ...]:
        return (("src", self.s), ("dst", self.o))


@dataclass(frozen=True)
class PairPattern:
    """Similarity clauses of one pair of terms, fused: rank of (s, o) and, if any, of (o, s)."""

    s: Term
    o: Term
    forward: int
    backward: int = 0

    @property
    def terms(self) -> tuple[tuple[str, Term], ...]:
        return (("src", self.s), ("dst", self.o))


Pattern = TriplePattern | SimPattern | PairPattern


@dataclass(frozen=True)
class Query:
    patterns: tuple[Pattern, ...]

    @property
    def variables(self) -> tuple[str, ...]:
        """In order of first appearance."""
        return tuple(dict.fromkeys(t.name for p in self.patterns for _, t in p.terms if isinstance(t, Var)))


def variables_of(pattern: Pattern) -> set[str]:
    return {t.name for _, t in pattern.terms if isinstance(t, Var)}
