"""Parser, normaliser and planner: no Spark needed."""

import random

import pytest

from lodegraph.plans.model import Const, PairPattern, SimPattern, TriplePattern, Var
from lodegraph.plans.normalize import normalize
from lodegraph.plans.parser import QuerySyntaxError, parse, parse_lines
from lodegraph.plans.planner import ORDERS, Statistics, is_connected, pattern_order, strongly_connected, variable_order
from lodegraph.plans.model import variables_of

ST = Statistics(1000, {1: (100, 50, 10), 6: (200, 200, 20), 69: (400, 200, 50)}, 50, 10)


def test_terms_and_order_of_variables():
    q = parse("?b 69 ?x .  ?a 1 7.?x k5 ?y . ")
    assert q.variables == ("b", "x", "a", "y")
    assert q.patterns[1] == TriplePattern(Var("a"), Const(1), Const(7))
    assert q.patterns[2] == SimPattern(Var("x"), Var("y"), 5)


def test_best_runs_as_one_and_must_agree():
    assert parse("?x b4 ?y").patterns[0] == SimPattern(Var("x"), Var("y"), 1, 4)
    with pytest.raises(ValueError, match="Incorrect query"):
        parse("?x b3 ?y . ?y b4 ?z")


@pytest.mark.parametrize("text", ["", " . ", "?x 1", "?x 1 2 3", "?x foo ?y", "k5 1 ?y", "?x 1 -2"])
def test_rejected(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_similarity_clauses_of_a_pair_are_fused():
    x, y = Var("x"), Var("y")
    assert normalize(parse("?x k5 ?y . ?x k9 ?y")).patterns == (PairPattern(x, y, 5),)
    assert normalize(parse("?x k5 ?y . ?y k9 ?x . ?x k3 ?y")).patterns == (PairPattern(x, y, 3, 9),)
    assert normalize(parse("?x k2 ?x")).patterns == (PairPattern(x, x, 2),)
    assert len(normalize(parse("?x 1 ?y . ?x 1 ?y")).patterns) == 1


def test_query_lines():
    assert parse_lines(["a\n", "\n", " b \n"]) == [(1, "a"), (2, "b")]


def test_strongly_connected_components_come_sources_first():
    found = strongly_connected({"a": {"b"}, "b": {"c"}, "c": {"b"}, "d": {"a"}})
    assert [sorted(x) for x in found] == [["d"], ["a"], ["b", "c"]]


@pytest.mark.parametrize("order", ORDERS)
def test_patterns_hang_together_in_every_order(order):
    """Random shapes like the benchmark's: two or three patterns of triples linked by similarity clauses."""
    rng = random.Random(5)
    for _ in range(200):
        parts = []
        n_components = rng.choice((1, 2, 3))
        for c in range(n_components):
            for i in range(rng.randint(1, 4)):
                parts.append(f"?v{c}_{rng.randint(0, i)} {rng.choice((1, 6, 69, f'?p{c}{i}'))} ?v{c}_{i + 1}")
        for c in range(1, n_components):
            parts.append(f"?v0_1 k50 ?v{c}_1")
            if rng.random() < 0.5:
                parts.append(f"?v{c}_1 k50 ?v0_1")
        rng.shuffle(parts)
        q = normalize(parse(" . ".join(parts)))
        assert sorted(variable_order(q, ST, order)) == sorted(q.variables)
        done = pattern_order(q, ST, order)
        assert sorted(map(repr, done)) == sorted(map(repr, q.patterns))
        if is_connected(q):
            bound = set(variables_of(done[0]))
            for p in done[1:]:
                assert variables_of(p) & bound, (q, done)
                bound |= variables_of(p)


def test_similarity_source_before_target_and_lonely_last():
    q = normalize(parse("?a 69 ?i . ?a 6 7 . ?b 69 ?j . ?b 6 7 . ?i k5 ?j . ?b ?vl1 ?vl2"))
    order = variable_order(q, ST)
    assert order.index("i") < order.index("j")
    assert set(order[-2:]) == {"vl1", "vl2"}
    with pytest.raises(ValueError):
        variable_order(q, ST, "other")


def test_orders_give_plans_of_their_own():
    from lodegraph.registry import TEXTS

    st = Statistics(170_000, {1: (25, 25, 5), 2: (2500, 2500, 25), 3: (15_000, 15_000, 1500), 4: (60_000, 15_000, 2000), 5: (60_000, 15_000, 100), 6: (2000, 2000, 25), 7: (1000, 1000, 4), 8: (1000, 1000, 7), 9: (1000, 1000, 10), 69: (5100, 3000, 1000), 12: (1000, 1000, 500)}, 1000, 10)
    plans = {o: [repr(pattern_order(normalize(parse(t)), st, o)) for t in TEXTS.values()] for o in ORDERS}
    for a in ORDERS:
        for b in ORDERS:
            assert a == b or plans[a] != plans[b], (a, b)
