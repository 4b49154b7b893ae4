"""A knowledge graph with a kNN graph, derived from the synthetic tables.

Ids: vectors from 1, documents 10 000 000+, parts 20 000 000+, suppliers
30 000 000+, customers 40 000 000+, nations 50 000 000+, regions 51 000 000+,
orders 60 000 000+, coded literals 70-73 000 000+.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators import knn as knn_ops
from lodegraph.operators.graph import Graph
from lodegraph.storage import new_path

K = 10
#: Lists of the workload.
K_WORKLOAD = 50
_OPEN: dict[tuple[str, str, int], Graph] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coded(df: DataFrame, column: str, base: int) -> DataFrame:
    """Each value with base + its rank among the distinct values (a few brands, languages or sources)."""
    return df.select(column).distinct().select(column, (F.lit(base) + F.row_number().over(Window.orderBy(column))).alias("code"))


def derived_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``s, p, o``."""
    t = {n: _table(spark, sf_dir, n) for n in ("nation", "supplier", "customer", "orders", "lineitem", "part", "documents", "embeddings")}
    n = t["embeddings"].agg(F.count("*").alias("n"))

    def rows(df, s, p, o):
        return df.select(s.cast("long").alias("s"), F.lit(p).cast("long").alias("p"), o.cast("long").alias("o"))

    def coded(name, key, base, p, column, code):
        return rows(t[name].join(F.broadcast(_coded(t[name], column, code)), column), F.col(key) + base, p, F.col("code"))

    def image(name, key, base, a, b):
        return rows(t[name].crossJoin(F.broadcast(n)), F.col(key) + base, 69, 1 + (F.col(key) * a + b) % F.col("n"))

    c = F.col
    parts = [
        rows(t["nation"], c("n_nationkey") + 50_000_000, 1, c("n_regionkey") + 51_000_000),
        rows(t["supplier"], c("s_suppkey") + 30_000_000, 2, c("s_nationkey") + 50_000_000),
        rows(t["customer"], c("c_custkey") + 40_000_000, 2, c("c_nationkey") + 50_000_000),
        rows(t["orders"], c("o_orderkey") + 60_000_000, 3, c("o_custkey") + 40_000_000),
        rows(t["lineitem"], c("l_orderkey") + 60_000_000, 4, c("l_partkey") + 20_000_000),
        rows(t["lineitem"], c("l_orderkey") + 60_000_000, 5, c("l_suppkey") + 30_000_000),
        coded("part", "p_partkey", 20_000_000, 6, "p_brand", 70_000_000),
        coded("documents", "doc_id", 10_000_000, 7, "lang", 71_000_000),
        coded("documents", "doc_id", 10_000_000, 8, "source", 72_000_000),
        rows(t["embeddings"], c("vec_id") + 1, 9, c("label") + 73_000_000),
        image("part", "p_partkey", 20_000_000, 7, 0),
        image("part", "p_partkey", 20_000_000, 11, 3),
        image("documents", "doc_id", 10_000_000, 13, 5),
        image("supplier", "s_suppkey", 30_000_000, 17, 1),
        rows(t["documents"], c("doc_id") + 10_000_000, 12, c("doc_id") + 10_000_000 - c("doc_id") % 2),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_ops.quantised(_table(spark, sf_dir, "embeddings"))


def derived_knn(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return knn_ops.build(vectors(spark, sf_dir), k)


def graph(spark: SparkSession, sf_dir: str, k: int = K) -> Graph:
    """The graph of a data folder with lists of k, built and written once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir, k)
    if key not in _OPEN:
        path = new_path(spark, "graph")
        Graph(derived_triples(spark, sf_dir), derived_knn(spark, sf_dir, k), distinct=True).save(path)
        _OPEN[key] = Graph.load(spark, path)
    return _OPEN[key]


# ---- the same in DuckDB's SQL ----------------------------------------------------------

TRIPLES_CTE = """triples as (
select distinct s::bigint s, p::bigint p, o::bigint o from (
 with n as (select count(*) n from embeddings)
 select 50000000+n_nationkey s,1 p,51000000+n_regionkey o from nation
 union all select 30000000+s_suppkey,2,50000000+s_nationkey from supplier
 union all select 40000000+c_custkey,2,50000000+c_nationkey from customer
 union all select 60000000+o_orderkey,3,40000000+o_custkey from orders
 union all select 60000000+l_orderkey,4,20000000+l_partkey from lineitem
 union all select 60000000+l_orderkey,5,30000000+l_suppkey from lineitem
 union all select 20000000+p_partkey,6,70000000+dense_rank() over(order by p_brand) from part
 union all select 10000000+doc_id,7,71000000+dense_rank() over(order by lang) from documents
 union all select 10000000+doc_id,8,72000000+dense_rank() over(order by source) from documents
 union all select vec_id+1,9,73000000+label from embeddings
 union all select 20000000+p_partkey,69,1+(p_partkey*7)%n from part,n
 union all select 20000000+p_partkey,69,1+(p_partkey*11+3)%n from part,n
 union all select 10000000+doc_id,69,1+(doc_id*13+5)%n from documents,n
 union all select 30000000+s_suppkey,69,1+(s_suppkey*17+1)%n from supplier,n
 union all select 10000000+doc_id,12,10000000+doc_id-doc_id%2 from documents))"""

PAIRS_CTE = """vec as (select vec_id+1 id, list_transform(embedding, lambda x: floor(x::double*10000)::bigint) v from embeddings),
pairs as (select a.id src, b.id dst, list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])*(z[1]-z[2])))::bigint dd from vec a, vec b where a.id<>b.id)"""


def knn_cte(k: int) -> str:
    return f"""{PAIRS_CTE},
knn as (select src::bigint src, dst::bigint dst, rank::int rank
from (select *, row_number() over(partition by src order by dd, dst) rank from pairs) where rank<={k})"""


KNN_CTE = knn_cte(K)


def oracle(text: str, k: int = K) -> str:
    """DuckDB SQL of a query text: every pattern a table, every repeated variable an equality."""
    tables, where, first = [], [], {}
    for i, pattern in enumerate(x.split() for x in text.split(".") if x.strip()):
        a, middle, b = pattern
        if middle[0] in "kb":
            most = 1 if middle[0] == "b" else int(middle[1:])
            tables.append(f"knn t{i}")
            where.append(f"t{i}.rank <= {most}")
            terms = (("src", a), ("dst", b))
        else:
            tables.append(f"triples t{i}")
            terms = (("s", a), ("p", middle), ("o", b))
        for column, term in terms:
            if term[0] != "?":
                where.append(f"t{i}.{column} = {term}")
            elif term[1:] in first:
                where.append(f"t{i}.{column} = {first[term[1:]]}")
            else:
                first[term[1:]] = f"t{i}.{column}"
    ctes = [cte for cte, name in ((TRIPLES_CTE, "triples t"), (knn_cte(k), "knn t")) if any(t.startswith(name) for t in tables)]
    columns = ", ".join(f'{c} as "{v}"' for v, c in first.items()) or "1::int as matched"
    return f"with {', '.join(ctes)}\nselect distinct {columns} from {', '.join(tables)}" + (f" where {' and '.join(where)}" if where else "")
