"""Registry of the graph engine's queries and their DuckDB oracles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import fixtures
from lodegraph.engine import Engine
from lodegraph.fixtures import K_WORKLOAD, KNN_CTE, TRIPLES_CTE, oracle
from lodegraph.operators import knn as knn_ops
from lodegraph.operators import stats
from lodegraph.operators.intersect import in_at_least
from lodegraph.plans.planner import ORDERS
from lodegraph.sources import lists, rdf, text
from lodegraph.storage import new_path

F1 = "?a 6 70000001 . ?a 69 ?i . ?b 7 71000001 . ?b 69 ?j . ?i k5 ?j"

#: Query texts; every one runs on the engine and, independently translated, on DuckDB.
TEXTS = {
    "scan_ccc": "50000000 1 51000000",
    "scan_ccv": "20000001 69 ?i",
    "scan_vcc": "?a 6 70000001",
    "scan_cvc": "50000000 ?p 51000000",
    "scan_cvv": "10000002 ?p ?o",
    "scan_vcv": "?o 3 ?c",
    "scan_vvc": "?x ?p 71000001",
    "scan_selfloop": "?x 12 ?x",
    "bgp_chain": "?o 3 ?c . ?c 2 ?n . ?n 1 51000001",
    "bgp_star": "?p 6 ?b . ?p 69 ?i . ?o 4 ?p . ?o 3 ?c",
    "bgp_cycle": "?o 3 ?c . ?c 2 ?n . ?s 2 ?n . ?o 5 ?s",
    "bgp_cross": "?n 1 51000001 . ?d 8 72000001 . ?d 7 71000001",
    "bgp_lonely": "?a 6 70000001 . ?a ?vl1 ?vl2 . ?a 69 ?i",
    "bgp_varpred": "20000001 ?p ?o . ?x ?p 70000001",
    "bgp_repeated": "?a 6 70000001 . ?a 69 ?i . ?a 6 70000001",
    "knn_scan": "?x k3 ?y",
    "knn_forward_const": "7 k5 ?y",
    "knn_reverse_const": "?x k5 7",
    "knn_exists": "?x k5 ?y . ?y k10 ?x . ?x 9 73000001 . ?y 9 73000001",
    "knn_exists_const": "1 k10 ?y . ?y 9 ?l . 1 9 ?l",
    "knn_mutual_const": "7 k10 ?y . ?y k10 7",
    "knn_const_join": "7 k10 ?y . ?y 9 ?l . ?d 69 ?y",
    "knn_triangle": "?x k10 ?y . ?y k10 ?z . ?x k10 ?z",
    "sim_join_uni": F1,
    "sim_join_uni_bgp": "?o 4 ?p . ?o 5 ?s . ?p 69 ?i . ?s 69 ?j . ?i k5 ?j",
    "sim_join_bi": "?o 4 ?p . ?o 5 ?s . ?p 69 ?i . ?s 69 ?j . ?i k10 ?j . ?j k10 ?i",
    "sim_join_bi_asym": F1 + " . ?j k10 ?i",
    "sim_attribute": "?x k10 ?y . ?x 9 ?l . ?y 9 ?l",
    "sim_chain": "?a 69 ?i . ?b 69 ?j . ?c 2 ?n . ?c 69 ?l . ?a 6 70000001 . ?b 7 71000001 . ?i k10 ?j . ?j k10 ?l",
    "sim_fork": "?a 6 70000001 . ?a 69 ?i . ?b 7 71000001 . ?b 69 ?j . ?c 2 50000003 . ?c 69 ?l . ?i k5 ?j . ?i k5 ?l",
    "sim_chain_bi": "?a 6 70000001 . ?a 69 ?i . ?b 7 71000001 . ?b 69 ?j . ?c 2 ?n . ?c 69 ?l . ?i k10 ?j . ?j k10 ?i . ?i k10 ?l . ?l k10 ?i",
    "sim_triangle": "?a 6 70000001 . ?a 69 ?i . ?b 7 71000001 . ?b 69 ?j . ?c 2 ?n . ?c 69 ?l . ?i k10 ?j . ?i k10 ?l . ?j k10 ?l",
    "sim_lonely": "?p 6 70000001 . ?p 69 ?i . ?s 69 ?j . ?s 2 ?n . ?i k5 ?j . ?p ?vl1 ?vl2",
    "sim_best": "?x b4 ?y . ?x 9 ?l",
    "sim_minus_k": "?x k5 ?y . ?x k9 ?y",
    "sim_beyond_k": "?x k11 ?y",
}
#: Shapes of a workload with long lists: two stars (a) or three (b) that similarity links one way, both ways or in a triangle,
#: similarity between two values of one node (c), and the same with every statement about the node (d).
_STAR_A, _STAR_B, _STAR_C = "?a 6 70000001 . ?a 69 ?i", "?b 7 71000001 . ?b 8 72000002 . ?b 69 ?j", "?c 2 50000003 . ?c 69 ?l"
WORKLOAD = {
    "k50_a": f"{_STAR_A} . {_STAR_B} . ?i k50 ?j",
    "k50_a_mutual": f"{_STAR_A} . {_STAR_B} . ?i k50 ?j . ?j k50 ?i",
    "k50_b": f"{_STAR_A} . {_STAR_B} . {_STAR_C} . ?i k50 ?j . ?i k50 ?l",
    "k50_b_mutual": f"{_STAR_A} . {_STAR_B} . {_STAR_C} . ?i k50 ?j . ?j k50 ?i . ?i k50 ?l . ?l k50 ?i",
    "k50_b_triangle": f"{_STAR_A} . {_STAR_B} . {_STAR_C} . ?i k50 ?j . ?i k50 ?l . ?j k50 ?l",
    "k50_c": "?o 4 ?a . ?a 69 ?i . ?a 69 ?j . ?i k50 ?j",
    "k50_c_mutual": "?o 4 ?a . ?a 69 ?i . ?a 69 ?j . ?i k50 ?j . ?j k50 ?i",
    "k50_d": "?a 6 70000001 . ?a 69 ?i . ?a 69 ?j . ?i k50 ?j . ?a ?vl1 ?vl2",
}
#: The ways in which a similarity clause meets what is bound when patterns go first.
POSTFILTER = {
    "postfilter_expand": "?a 6 70000001 . ?a 69 ?i . ?i k5 ?j",
    "postfilter_expand_inverse": "?a 6 70000001 . ?a 69 ?j . ?i k5 ?j",
    "postfilter_product": "?n 1 51000001 . ?x k2 ?y",
    "postfilter_filter": "?a 69 ?i . ?a 69 ?j . ?i k10 ?j",
}
BATCH = (F1, TEXTS["bgp_chain"], TEXTS["sim_best"], TEXTS["knn_mutual_const"], TEXTS["scan_vcc"])


def _run(spark: SparkSession, sf_dir: str, query: str, k: int = fixtures.K, **options) -> DataFrame:
    return Engine(fixtures.graph(spark, sf_dir, k)).query(query, **options)


def src_triples(spark, sf_dir):
    path = new_path(spark, "triples-text")
    text.write_triples(fixtures.graph(spark, sf_dir).triples, path)
    return text.read_triples(spark, path)


def scan_vvv(spark, sf_dir):
    return _run(spark, sf_dir, "?s ?p ?o").groupBy("p").agg(F.count("*").alias("n"), F.sum("s").alias("sum_s"), F.sum("o").alias("sum_o"))


def knn_graph(spark, sf_dir):
    """Through the file of neighbour lists and back."""
    path = new_path(spark, "knn-text")
    graph = fixtures.graph(spark, sf_dir)
    text.write_neighbours(graph.knn, fixtures.vectors(spark, sf_dir).select("id"), path)
    return text.read_neighbours(spark, path)


def knn_inverse(spark, sf_dir):
    return knn_ops.inverse(fixtures.graph(spark, sf_dir).knn).select("dst", F.col("pos").cast("int").alias("pos"), "src", "rank")


def knn_truncate(spark, sf_dir):
    knn = fixtures.graph(spark, sf_dir).knn
    return knn_ops.truncated(knn.select(F.col("src").alias("n1"), F.col("dst").alias("n2"), F.col("rank").alias("pos")), 4)


def knn_symmetric(spark, sf_dir):
    knn = fixtures.graph(spark, sf_dir).knn
    pairs = knn.select(F.least("src", "dst").alias("e1"), F.greatest("src", "dst").alias("e2"), (F.abs(F.col("src") - F.col("dst")) % 97).cast("double").alias("dist")).distinct()
    return knn_ops.symmetric(pairs, 5)


def knn_fused(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).mutual


def knn_convert(spark, sf_dir):
    """A file of pairs of terms, encoded and cut."""
    path, term = new_path(spark, "pairs-text"), lambda c: F.concat(F.lit("<image/"), (F.col(c) * 7).cast("string"), F.lit(">"))
    knn = fixtures.graph(spark, sf_dir).knn
    knn.orderBy(F.desc("src"), "rank").select(F.concat_ws(" ", term("src"), term("dst")).alias("value")).write.text(path)
    return lists.read_pairs(spark, path, fixtures.vectors(spark, sf_dir).select("id", term("id").alias("term")), 6)


def knn_padded(spark, sf_dir):
    return lists.padded(fixtures.graph(spark, sf_dir).knn, 12).select("src", F.concat_ws(" ", F.col("list").cast("array<string>")).alias("list"))


def knn_distances(spark, sf_dir):
    """A file of pairs with distances, farthest lists first."""
    path = new_path(spark, "distances-text")
    line = F.concat(F.lit("('"), F.col("src"), F.lit("#"), F.col("dst"), F.lit("', 0."), F.col("rank"), F.lit(")"))
    fixtures.graph(spark, sf_dir).knn.orderBy("rank", F.desc("src")).select(line.alias("value")).write.text(path)
    return lists.read_distances(spark, path, 8)[0]


def t_of_n(spark, sf_dir):
    """Images of two or more of a brand, a language and a nation."""
    texts = ("?a 6 70000001 . ?a 69 ?i", "?b 7 71000001 . ?b 69 ?i", "?c 2 50000003 . ?c 69 ?i")
    return in_at_least([_run(spark, sf_dir, t, select=["i"]) for t in texts], 2)


def stats_predicate(spark, sf_dir):
    return stats.by_predicate(fixtures.graph(spark, sf_dir).triples)


def _turtle_lines(spark, sf_dir) -> DataFrame:
    """Lines about nations, regions and customers: URIs, and literals with dots, spaces and quotes."""
    nation, region, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region", "customer"))
    uri = lambda kind, c: F.concat(F.lit(f"<http://graph/{kind}/"), F.col(c).cast("string"), F.lit(">"))
    line = lambda df, s, p, o: df.select(F.concat(s, F.lit(f" <http://graph/{p}> "), o, F.lit(" .")).alias("value"))
    quote = lambda c: F.concat(F.lit('"A. '), F.col(c), F.lit(' \\"x\\" b."@en'))
    return (
        line(nation, uri("nation", "n_nationkey"), "inRegion", uri("region", "n_regionkey"))
        .unionByName(line(region, uri("region", "r_regionkey"), "name", quote("r_name")))
        .unionByName(line(customer, uri("customer", "c_custkey"), "inNation", uri("nation", "c_nationkey")))
        .unionByName(line(customer, uri("customer", "c_custkey"), "segment", F.col("c_mktsegment")))
    )


_RDF_CTE = """rdf as (
 select '<http://graph/nation/' || n_nationkey || '>' s, '<http://graph/inRegion>' p, '<http://graph/region/' || n_regionkey || '>' o from nation
 union all select '<http://graph/region/' || r_regionkey || '>', '<http://graph/name>', '"A. ' || r_name || ' \\"x\\" b."@en' from region
 union all select '<http://graph/customer/' || c_custkey || '>', '<http://graph/inNation>', '<http://graph/nation/' || c_nationkey || '>' from customer
 union all select '<http://graph/customer/' || c_custkey || '>', '<http://graph/segment>', c_mktsegment from customer)"""
_NODES_CTE = "nodes as (select term, row_number() over (order by term) id from (select s term from rdf union select o from rdf)), preds as (select p term, row_number() over (order by p) id from (select distinct p from rdf))"


def rdf_parse(spark, sf_dir):
    return rdf.parsed(_turtle_lines(spark, sf_dir))


def rdf_prefix_filter(spark, sf_dir):
    return rdf.with_prefix(rdf_parse(spark, sf_dir), "<http://graph/in")


def dict_encode(spark, sf_dir):
    triples = rdf_parse(spark, sf_dir)
    return rdf.encoded(triples, *rdf.dictionaries(triples))


def dict_decode(spark, sf_dir):
    triples = rdf_parse(spark, sf_dir)
    known = rdf.dictionaries(triples)
    return rdf.turtle(rdf.decoded(rdf.encoded(triples, *known), *known))


def dict_append(spark, sf_dir):
    """Dictionaries of the nations' triples, then the customers' appended."""
    triples = rdf_parse(spark, sf_dir)
    old = triples.where(~F.col("s").startswith("<http://graph/customer/"))
    nodes, _ = rdf.appended(triples, *rdf.dictionaries(old))
    return nodes


def batch_counts(spark, sf_dir):
    return Engine(fixtures.graph(spark, sf_dir)).counts(list(BATCH))


def queries() -> dict:
    found = {name: partial(_run, query=query) for name, query in TEXTS.items()}
    found |= {
        "src_triples": src_triples,
        "scan_vvv": scan_vvv,
        "bgp_limit": partial(_run, query=TEXTS["bgp_chain"], ordered=True, limit=100),
        "bgp_select": partial(_run, query=TEXTS["bgp_chain"], select=["n", "c"]),
        "knn_build": fixtures.derived_knn,
        "knn_graph": knn_graph,
        "knn_inverse": knn_inverse,
        "knn_truncate": knn_truncate,
        "knn_symmetric": knn_symmetric,
        "knn_fused": knn_fused,
        "knn_convert": knn_convert,
        "knn_padded": knn_padded,
        "knn_distances": knn_distances,
        "t_of_n": t_of_n,
        "strategy_postfilter": partial(_run, query=TEXTS["sim_join_bi"], strategy="postfilter"),
        "strategy_semijoin": partial(_run, query=TEXTS["sim_triangle"], strategy="semijoin"),
        "order_simple": partial(_run, query=TEXTS["sim_chain"], order="simple"),
        "order_weight": partial(_run, query=TEXTS["sim_chain"], order="weight"),
        "order_sets": partial(_run, query=TEXTS["sim_lonely"], order="sets"),
        **{name: partial(_run, query=query, k=K_WORKLOAD) for name, query in WORKLOAD.items()},
        **{name: partial(_run, query=query, strategy="postfilter") for name, query in POSTFILTER.items()},
        **{f"order_{order}_fork": partial(_run, query=TEXTS["sim_fork"], order=order) for order in ORDERS[1:]},
        "stats_predicate": stats_predicate,
        "stats_graph": lambda spark, sf_dir: stats.of_graph(fixtures.graph(spark, sf_dir).triples),
        "stats_knn": lambda spark, sf_dir: stats.of_knn(fixtures.graph(spark, sf_dir).knn),
        "rdf_parse": rdf_parse,
        "rdf_prefix_filter": rdf_prefix_filter,
        "dict_encode": dict_encode,
        "dict_decode": dict_decode,
        "dict_append": dict_append,
        "batch_counts": batch_counts,
    }
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: oracle(query) for name, query in TEXTS.items()}
    chain, rank = oracle(TEXTS["bgp_chain"]), "row_number() over (partition by {} order by {})::int"
    counts = "\nunion all ".join(f"select {i}::int query_no, count(*) n from ({oracle(q)})" for i, q in enumerate(BATCH, 1))
    found |= {
        "sim_beyond_k": f"select * from ({oracle(TEXTS['sim_beyond_k'])}) where false",  # no list is that long
        "src_triples": f"with {TRIPLES_CTE} select s, p, o from triples",
        "scan_vvv": f"with {TRIPLES_CTE} select p, count(*) n, sum(s)::bigint sum_s, sum(o)::bigint sum_o from triples group by p",
        "bgp_limit": f"select * from ({chain}) order by o, c, n limit 100",
        "bgp_select": f"select distinct n, c from ({chain})",
        "knn_build": f"with {KNN_CTE} select src, dst, rank from knn",
        "knn_graph": f"with {KNN_CTE} select src, dst, rank from knn",
        "knn_inverse": f"with {KNN_CTE} select dst, {rank.format('dst', 'rank, src')} pos, src, rank from knn",
        "knn_truncate": f"with {KNN_CTE} select * from (select src, dst, {rank.format('src', 'knn.rank, dst')} rank from knn) where rank <= 4",
        "knn_symmetric": f"""with {KNN_CTE}, e as (select distinct least(src, dst) a, greatest(src, dst) b, abs(src - dst) % 97 d from knn),
u as (select a src, b dst, d from e union select b, a, d from e)
select * from (select src, dst, {rank.format('src', 'd, dst')} rank from u) where rank <= 5""",
        "knn_fused": f"with {KNN_CTE} select a.src, a.dst, a.rank rank_fwd, b.rank rank_bwd from knn a join knn b on a.src = b.dst and a.dst = b.src",
        "strategy_postfilter": oracle(TEXTS["sim_join_bi"]),
        "strategy_semijoin": oracle(TEXTS["sim_triangle"]),
        "order_simple": oracle(TEXTS["sim_chain"]),
        "order_weight": oracle(TEXTS["sim_chain"]),
        "order_sets": oracle(TEXTS["sim_lonely"]),
        **{name: oracle(query, K_WORKLOAD) for name, query in WORKLOAD.items()},
        **{name: oracle(query) for name, query in POSTFILTER.items()},
        **{f"order_{order}_fork": oracle(TEXTS["sim_fork"]) for order in ORDERS[1:]},
        "knn_convert": f"with {KNN_CTE} select src, dst, rank from knn where rank <= 6",
        "knn_padded": f"with {KNN_CTE} select src, string_agg(dst::varchar, ' ' order by rank) || repeat(' 0', (12 - count(*))::bigint) list from knn group by src",
        "knn_distances": f"""with {KNN_CTE}, l as (select src, dst, row_number() over (order by rank, src desc) line from knn),
e as (select src entity, dst other, 2 * line seen from l union all select dst, src, 2 * line + 1 from l),
n as (select entity, row_number() over (order by min(seen)) id from e group by entity),
r as (select *, {rank.format('entity', 'seen')} rank from e)
select a.id::bigint src, b.id::bigint dst, rank from r join n a on a.entity = r.entity join n b on b.entity = r.other where rank <= 8""",
        "t_of_n": "select value, count(*) n from (" + " union all ".join(f"select distinct i as value from ({oracle(t)})" for t in ("?a 6 70000001 . ?a 69 ?i", "?b 7 71000001 . ?b 69 ?i", "?c 2 50000003 . ?c 69 ?i")) + ") group by value having count(*) >= 2",
        "stats_predicate": f"with {TRIPLES_CTE} select p, count(*) n, count(distinct s) n_s, count(distinct o) n_o from triples group by p",
        "stats_graph": f"with {TRIPLES_CTE} select count(*) n_triples, max(s) max_s, max(p) max_p, max(o) max_o from triples",
        "stats_knn": f"with {KNN_CTE} select max(rank)::int max_k, count(distinct src) nodes, count(*) n_edges from knn",
        "rdf_parse": f"with {_RDF_CTE} select s, p, o from rdf",
        "rdf_prefix_filter": f"with {_RDF_CTE} select s, p, o from rdf where starts_with(p, '<http://graph/in')",
        "dict_encode": f"with {_RDF_CTE}, {_NODES_CTE} select a.id s, b.id p, c.id o from rdf join nodes a on a.term = s join preds b on b.term = p join nodes c on c.term = o",
        "dict_decode": f"with {_RDF_CTE} select s || ' ' || p || ' ' || o || ' .' as value from rdf",
        "dict_append": f"""with {_RDF_CTE}, old as (select term, row_number() over (order by term) id from
 (select s term from rdf where not starts_with(s, '<http://graph/customer/') union select o from rdf where not starts_with(s, '<http://graph/customer/')))
select id, term from old union all
select (select max(id) from old) + row_number() over (order by term) id, term from (select s term from rdf union select o from rdf) where term not in (select term from old)""",
        "batch_counts": counts,
    }
    return found


