"""Text files, dictionaries and the kNN graph's construction."""

import logging

import numpy as np
import pytest

from lodegraph.operators import knn as knn_ops
from lodegraph.operators.intersect import in_at_least
from lodegraph.operators.numbering import numbered
from lodegraph.sources import lists, rdf, text


def test_triples_file_with_repeated_last_line(spark, tmp_path):
    (tmp_path / "t.dat").write_text("1 1 2\n2\t1  3\n\n2 1 3\n")
    assert sorted(map(tuple, text.read_triples(spark, str(tmp_path / "t.dat")).collect())) == [(1, 1, 2), (2, 1, 3)]


def test_neighbour_lists_of_unequal_length(spark, tmp_path):
    (tmp_path / "k.dat").write_text("2 3 4\n1 0 0\n\n1 2\n")
    got = sorted(map(tuple, text.read_neighbours(spark, str(tmp_path / "k.dat")).collect()))
    assert got == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 1), (4, 1, 1), (4, 2, 2)]


def test_neighbour_lists_over_many_splits(spark, tmp_path):
    knn = [(a, (a * 7 + r) % 500 + 1, r) for a in range(1, 501) for r in range(1, 4) if a % 5]
    df = spark.createDataFrame(knn, "src long, dst long, rank int")
    text.write_neighbours(df, spark.range(1, 501).withColumnRenamed("id", "id"), str(tmp_path / "k"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted(map(tuple, text.read_neighbours(spark, str(tmp_path / "k")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(knn)


def test_turtle_terms(spark):
    lines = ["<http://a> <http://p> <http://b> .", '<a> <p> "x. y \\" z."@en .', "bare p token", "", "<only> <two>"]
    got = [tuple(r) for r in rdf.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("<http://a>", "<http://p>", "<http://b>"), ("<a>", "<p>", '"x. y \\" z."@en'), ("bare", "p", "token")]


def test_dictionaries_round_trip_and_append(spark, tmp_path):
    triples = spark.createDataFrame([("<b>", "<p>", "<a>"), ("<a>", "<q>", '"l. x"')], "s string, p string, o string")
    nodes, predicates = rdf.dictionaries(triples)
    assert [(r["id"], r["term"]) for r in nodes.orderBy("id").collect()] == [(1, '"l. x"'), (2, "<a>"), (3, "<b>")]
    again = rdf.decoded(rdf.encoded(triples, nodes, predicates), nodes, predicates)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, triples.collect()))
    more = spark.createDataFrame([("<0>", "<p>", "<z>")], triples.schema)
    nodes2, predicates2 = rdf.appended(more, nodes, predicates)
    assert [(r["id"], r["term"]) for r in nodes2.orderBy("id").collect()][3:] == [(4, "<0>"), (5, "<z>")]
    assert predicates2.count() == 2
    rdf.write_dictionary(nodes2, str(tmp_path / "d"))
    assert sorted(map(tuple, rdf.read_dictionary(spark, str(tmp_path / "d")).collect())) == sorted(map(tuple, nodes2.select("id", "term").collect()))
    assert rdf.with_prefix(triples, "<p").count() == 1


def test_numbering_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(f"t{i:05d}",) for i in np.random.default_rng(1).permutation(2000)], "term string")
    got = numbered(df, ["term"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 2001)) and [r["term"] for r in got] == sorted(r["term"] for r in got)


def test_exact_knn_with_ties_over_several_blocks(spark):
    v = np.random.default_rng(2).integers(-3, 4, (90, 3))
    df = spark.createDataFrame([(i + 1, [int(x) for x in row]) for i, row in enumerate(v)], "id long, v array<long>")
    got = {(r["src"], r["rank"]): r["dst"] for r in knn_ops.build(df, 4, block=25).collect()}
    want = {}
    for i in range(90):
        order = sorted((int(((v[i] - v[j]) ** 2).sum()), j + 1) for j in range(90) if j != i)
        want |= {(i + 1, r + 1): order[r][1] for r in range(4)}
    assert got == want


def test_symmetric_and_truncated_lists(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.2), (2, 3, 0.1)], "e1 long, e2 long, dist double")
    assert sorted(map(tuple, knn_ops.symmetric(pairs, 1).collect())) == [(1, 3, 1), (2, 3, 1), (3, 2, 1)]
    lists = spark.createDataFrame([(1, 5, 3), (1, 6, 1), (2, 7, 1)], "n1 long, n2 long, pos int")
    assert sorted(map(tuple, knn_ops.truncated(lists, 1).collect())) == [(1, 6, 1), (2, 7, 1)]


def test_lists_from_pairs_of_terms(spark, tmp_path, caplog):
    """Short lists, lists that are cut, terms that the dictionary lacks."""
    (tmp_path / "p.tsv").write_text("<b> <a>\n<b>  <c>\n<b> <d>\n\n<a> <c>\n<x> <a>\n<c> <x>\n<c> <b>\n")
    nodes = spark.createDataFrame([(1, "<a>"), (2, "<b>"), (3, "<c>"), (4, "<d>")], "id long, term string")
    knn = lists.read_pairs(spark, str(tmp_path / "p.tsv"), nodes, 2)
    assert sorted(map(tuple, knn.collect())) == [(1, 3, 1), (2, 1, 1), (2, 3, 2), (3, 2, 1)]
    with caplog.at_level(logging.WARNING):
        lists.write_padded(knn, 2, str(tmp_path / "out"))
    assert "2 lists are shorter than k = 2" in caplog.text
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["3 0", "1 3", "2 0"]


def test_lists_from_distances(spark, tmp_path):
    """Both directions in the order of the lines, entities numbered as they appear."""
    (tmp_path / "d.txt").write_text("('70#30', 0.1)\nnothing\n('70#50', 0.2)\n('30#50', 0.3)\n('70#90', 0.4)\n")
    knn, entities = lists.read_distances(spark, str(tmp_path / "d.txt"), 2)
    assert sorted(map(tuple, entities.collect())) == [(1, 70), (2, 30), (3, 50), (4, 90)]
    assert sorted(map(tuple, knn.collect())) == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2), (4, 1, 1)]


def test_values_in_some_of_many_sets(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    sets = [one(1, 1, 2, 3), one(2, 3, 3), one(3, 4)]
    assert sorted(map(tuple, in_at_least(sets).collect())) == [(3, 3)]
    assert sorted(map(tuple, in_at_least(sets, 2).collect())) == [(2, 2), (3, 3)]


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_nearest_neighbours_with_ties(spark, block):
    rng = np.random.default_rng(block)
    v = rng.integers(0, 3, (60, 4))
    df = spark.createDataFrame([(i + 1, [int(x) for x in r]) for i, r in enumerate(v)], "id long, v array<long>")
    got = sorted(map(tuple, knn_ops.build(df, 5, block).collect()))
    want = []
    for i, a in enumerate(v):
        near = sorted((int(((a - b) ** 2).sum()), j + 1) for j, b in enumerate(v) if j != i)[:5]
        want += [(i + 1, j, r) for r, (_, j) in enumerate(near, 1)]
    assert got == sorted(want)
    few = sorted(map(tuple, knn_ops.build(df.where("id <= 3"), 5, block).collect()))
    assert [(s, r) for s, _, r in few] == [(s, r) for s in (1, 2, 3) for r in (1, 2)] or len(few) == 6
    with pytest.raises(Exception, match="64 bits"):
        knn_ops.build(spark.createDataFrame([(1, [2**40]), (2, [0])], "id long, v array<long>"), 1).collect()
