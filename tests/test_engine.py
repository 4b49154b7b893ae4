"""The engine on small graphs against nested loops, and its corner cases."""

import random

import pytest

from lodegraph.engine import Engine, QueryTimeout
from lodegraph.operators.graph import Graph
from lodegraph.plans.model import Const, SimPattern
from lodegraph.plans.parser import parse
from lodegraph.sources import text as text_files

TRIPLES = [(1, 1, 2), (1, 1, 2), (2, 1, 3), (5, 1, 5), (3, 2, 1), (1, 2, 1), (4, 7, 7), (7, 7, 4), (3, 69, 1), (4, 69, 2), (2, 69, 3)]
KNN = {1: [2, 3, 4, 5], 2: [1, 3, 5, 4], 3: [1, 2], 5: [1, 4, 2, 3]}


@pytest.fixture(scope="module")
def graph(spark):
    knn = [(a, b, i) for a, l in KNN.items() for i, b in enumerate(l, 1)]
    return Graph(spark.createDataFrame(TRIPLES, "s long, p long, o long").repartition(2).cache(), spark.createDataFrame(knn, "src long, dst long, rank int").repartition(2).cache())


def nested_loops(text: str) -> set:
    q = parse(text)
    found = [{}]
    for p in q.patterns:
        if isinstance(p, SimPattern):
            rows = [(a, b) for a, l in KNN.items() for b in l[: p.k]] if p.k <= 4 else []
        else:
            rows = set(TRIPLES)
        terms = [t for _, t in p.terms]
        new = []
        for binding in found:
            for row in rows:
                b = dict(binding)
                if all((t.value == v) if isinstance(t, Const) else b.setdefault(t.name, v) == v for t, v in zip(terms, row)):
                    new.append(b)
        found = new
    return {tuple(b[v] for v in q.variables) for b in found}


CASES = [
    "?x 1 ?x", "?x k2 ?x", "?x k4 ?y . ?x k2 ?y", "?x k2 ?y . ?y k3 ?x", "?y k3 ?x . ?x 69 ?y", "?x k1 ?y . ?y k4 ?x . ?x k3 ?y",
    "?x k9 ?y", "1 1 2", "1 1 3", "1 k2 3", "3 k4 ?y", "?x k4 4", "?x 1 ?y . ?a 2 ?b", "?x ?p ?y . ?p 7 ?z", "?x ?p ?y . ?z ?p ?w",
    "?x  1   ?y . ", "?a 69 ?x . ?b 69 ?y . ?x k4 ?y", "?a 69 ?x . ?b 69 ?y . ?c 69 ?z . ?x k4 ?y . ?y k4 ?z . ?x k4 ?z", "1 k1 2 . ?x 1 ?y", "1 k1 3 . ?x 1 ?y",
]


@pytest.mark.parametrize("strategy", ["flat", "postfilter", "semijoin"])
@pytest.mark.parametrize("text", CASES)
def test_against_nested_loops(graph, text, strategy):
    df = Engine(graph).query(text, strategy=strategy)
    rows = df.collect()
    variables = parse(text).variables
    if not variables:
        assert df.columns == ["matched"] and len(rows) == (1 if nested_loops(text) else 0)
    else:
        assert df.columns == list(variables)
        assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == nested_loops(text)


def test_random_queries_agree_in_all_strategies(graph):
    rng = random.Random(3)
    engine = Engine(graph)
    for _ in range(12):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a, b = (rng.choice(("?x", "?y", "?z", "?w", "1", "3")) for _ in range(2))
            parts.append(f"{a} {rng.choice(('1', '2', '69', '?p', 'k1', 'k2', 'k4'))} {b}")
        text = " . ".join(parts)
        want = nested_loops(text)
        for options in ({}, {"strategy": "postfilter"}, {"strategy": "semijoin"}, {"order": "simple"}):
            rows = engine.query(text, **options).collect()
            got = {tuple(r) for r in rows} if parse(text).variables else ({()} if rows else set())
            assert got == want, (text, options)


def test_connected_queries_have_no_product(graph):
    engine = Engine(graph)
    for text in ("?a 69 ?x . ?b 69 ?y . ?x k4 ?y", "?a 69 ?x . ?b 1 ?y . ?x k2 ?y . ?y k2 ?x . ?a ?v ?w"):
        plan = engine.query(text)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_k_beyond_the_graph(graph):
    assert Engine(graph).query("?x k9 ?y").isEmpty()
    with pytest.raises(ValueError):
        Engine(graph).query("?x k9 ?y", strict=True)


def test_limit_select_timeout_and_description(graph, spark):
    engine = Engine(graph)
    assert [tuple(r) for r in engine.query("?x 1 ?y", ordered=True, limit=2).collect()] == [(1, 2), (2, 3)]
    assert engine.query("?x 1 ?y", select=["y"]).columns == ["y"]
    assert len(engine.collect("?x 1 ?y")) == 3
    with pytest.raises(QueryTimeout):
        engine.collect("?a ?b ?c . ?d ?e ?f . ?g ?h ?i . ?j ?k ?l . ?m ?n ?o . ?p ?q ?r", timeout=0.5)
    text = engine.describe("?x k2 ?y . ?y k3 ?x")
    assert "?x k2 ?y" in text and "plan:" in text
    with pytest.raises(ValueError):
        engine.query("?x 1 ?y", strategy="other")


def test_save_load_and_query_file(graph, spark, tmp_path):
    graph.save(str(tmp_path / "g"))
    engine = Engine.open(spark, str(tmp_path / "g"))
    (tmp_path / "q.tsv").write_text("?x 1 ?y\n\n?x k2 ?y . ?y k2 ?x\n")
    found = engine.run_file(str(tmp_path / "q.tsv"))
    assert [(a, b) for a, b, _ in found] == [(1, 3), (2, len(nested_loops("?x k2 ?y . ?y k2 ?x")))]
    assert all(ns > 0 for *_, ns in found)
    plan = engine.query("1 69 ?y")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "PushedFilters: [IsNotNull(s)" in plan
    with open(tmp_path / "stats", "w") as sink:
        limited = engine.run_file(str(tmp_path / "q.tsv"), limit=2, sink=sink)
    lines = [x.split(";") for x in (tmp_path / "stats").read_text().splitlines()]
    assert [(int(a), int(b)) for a, b, _ in lines] == [(a, b) for a, b, _ in limited] and [b for _, b, _ in limited] == [2, 2]
    text_files.write_result(engine.query("?x 1 ?y"), str(tmp_path / "res"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "res")).collect()) == ["?x=1 ?y=2", "?x=2 ?y=3", "?x=5 ?y=5"]


def test_written_copies_prune_and_hold_the_same(graph, spark, tmp_path):
    graph.save(str(tmp_path / "g"))
    engine = Engine.open(spark, str(tmp_path / "g"))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    loaded = engine.graph
    assert rows(loaded.triples, "s", "p", "o") == rows(loaded.by_subject, "s", "p", "o") == rows(loaded.by_object, "s", "p", "o") == sorted(set(TRIPLES))
    assert rows(loaded.knn, "src", "dst", "rank") == rows(loaded.knn_by_target, "src", "dst", "rank")
    assert loaded.statistics == graph.statistics
    plan = lambda text: engine.query(text)._jdf.queryExecution().executedPlan().toString()
    read = lambda text: {f.split("/g/")[1].split("/")[0] for f in engine.query(text).inputFiles()}
    assert read("1 ?p ?o") == read("1 ?p 2") == {"by_subject"} and "EqualTo(s,1)" in plan("1 ?p ?o")
    assert read("?x ?p 2") == {"by_object"} and "EqualTo(o,2)" in plan("?x ?p 2") and read("?x 1 ?y") == {"triples"}
    assert read("?x k2 4") == {"knn_by_target"} and read("4 k2 ?x") == {"knn"}
    assert read("?x k2 ?y . ?y k3 ?x") == {"mutual"} and "Join" not in plan("?x k2 ?y . ?y k3 ?x")
    for text in CASES:
        if parse(text).variables:
            assert {tuple(r) for r in engine.query(text).collect()} == nested_loops(text)


def test_a_query_that_has_not_begun_is_cancelled_too(graph, monkeypatch):
    """The time runs out while the query is planned, when none of its jobs runs."""
    import time

    engine = Engine(graph)
    query = engine.query
    monkeypatch.setattr(engine, "query", lambda *a, **b: (time.sleep(0.5), query(*a, **b))[1])
    with pytest.raises(QueryTimeout):
        engine.count("?a ?b ?c . ?d ?e ?f . ?g ?h ?i . ?j ?k ?l . ?m ?n ?o . ?p ?q ?r", timeout=0.1)
    assert graph.triples.sparkSession.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert engine.count("?x 1 ?y") == 3
