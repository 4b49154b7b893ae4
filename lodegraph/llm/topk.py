"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are sparse integer rows; a term is a dimension. Candidates and queries
are dealt into blocks of bounded size, and a cell of the grid (query block x
candidate block) is one task's work: the block's posting lists are built once,
and for each term its list is scattered, weighted by the query rows, into the
dense score arrays of those queries. A partition selection keeps the k best of
the cell, and the cells' lists are merged by a window over the query.

The grid has every pair of blocks, so the work is what a stated query set
against all rows needs; a row is sent once for each block of the other side, and
blocks are as large as a task's memory allows, but small enough for every core
to get a cell. Rows that repeat an id are candidates each.

Defined cases: vectors that are null or hold a null or non-finite component
take no part, neither as query nor as candidate; ties go to the smaller id;
a query is not its own candidate (rows that share an id are one another's
candidates only if their ids differ); fewer than k candidates are returned as
they are; missing dimensions count as 0; components are limited to 2**40 in
size and scores to 64 bits, beyond which the query fails with an error rather
than returning a wrong score; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm.common import ship

QUERY_BLOCK = 1 << 13
CANDIDATE_BLOCK = 1 << 16
#: Elements of the score arrays that are held at once.
SCORE_ELEMENTS = 1 << 19

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return values.reshape(len(lengths), -1)
    dense = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    dense[np.arange(dense.shape[1])[None, :] < lengths[:, None]] = values
    return dense


def postings(candidates: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Of every term the places of the rows that have it, with its weights there. A list of more than half of all rows is kept
    as an array of all weights, which takes less than places would (and None for these)."""
    found = []
    for term in range(candidates.shape[1]):
        weights = np.ascontiguousarray(candidates[:, term])
        places = np.flatnonzero(weights)
        found.append((places, weights[places]) if 2 * len(places) < len(weights) else (None, weights))
    return found


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], n: int, dtype) -> np.ndarray:
    """Scores (queries x n candidates), one term after the other."""
    scores = np.zeros((len(queries), n), dtype)
    scratch = np.empty_like(scores)
    for weights, (places, posting) in zip(queries.T, lists):
        rows_with = np.flatnonzero(weights)
        if not len(rows_with) or not len(posting):
            continue
        if places is not None:
            for row in rows_with:  # places are distinct, so every one gets its product once
                scores[row, places] += weights[row] * posting
        else:
            np.multiply(weights[:, None], posting[None, :], out=scratch)
            scores += scratch
    return scores


def _cell(table: pa.Table, k: int) -> pa.Table:
    is_query = table.column("is_query").to_numpy(zero_copy_only=False)
    ids, vectors = table.column("id").to_numpy(), _matrix(table.column("terms"))
    q_ids, q = ids[is_query], vectors[is_query]
    order = np.argsort(ids[~is_query], kind="stable")
    c_ids, c = ids[~is_query][order], vectors[~is_query][order]
    if not len(q_ids) or not len(c_ids):
        return _OUT.empty_table()
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound >= 1 << 62:
        raise ValueError("inner products do not fit into 64 bits")
    dtype = np.int32 if bound < 1 << 30 else np.int64
    lists, q = postings(c.astype(dtype)), q.astype(dtype)
    n, step, found = len(c_ids), max(1, SCORE_ELEMENTS // len(c_ids)), []
    for at in range(0, len(q_ids), step):
        scores = accumulate(q[at : at + step], lists, n, dtype)
        for i, own in enumerate(scores):
            me = q_ids[at + i]
            # The k-th best score, with room for the query's own rows.
            low, high = np.searchsorted(c_ids, me, "left"), np.searchsorted(c_ids, me, "right")
            want = k + int(high - low)
            if n > want:
                least = np.partition(own, n - want)[n - want]
                above = np.flatnonzero(own > least)
                tied = np.flatnonzero(own == least)[: want - len(above)]  # ids ascend, so the smallest of the tied
                kept = np.concatenate([above, tied])
            else:
                kept = np.arange(n)
            kept = kept[(kept < low) | (kept >= high)]
            kept = kept[np.lexsort((c_ids[kept], -own[kept].astype(np.int64)))][:k]
            found.append((np.full(len(kept), me), c_ids[kept], own[kept].astype(np.int64)))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], schema=_OUT)


def _dealt(df: DataFrame, n_blocks: int, n_other: int, own: str, other: str) -> DataFrame:
    """Every row in its block, once for each block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64("id", "terms"), F.lit(n_blocks))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` for integer vectors given as ``id, terms`` (array of long)."""
    ship(vectors.sparkSession)
    n_q, n_c = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (vectors, CANDIDATE_BLOCK)))
    n_c = max(n_c, -(-vectors.sparkSession.sparkContext.defaultParallelism // n_q))
    both = _dealt(queries, n_q, n_c, "qb", "cb").select("qb", "cb", F.lit(True).alias("is_query"), "id", "terms").unionByName(
        _dealt(vectors, n_c, n_q, "cb", "qb").select("qb", "cb", F.lit(False).alias("is_query"), "id", "terms")
    )
    best = both.groupBy("qb", "cb").applyInArrow(lambda t: _cell(t, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_terms(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``id, terms``: floor(scale * x) of every component; vectors that take no part are left out."""
    x = F.col(vector_col).cast("array<double>")
    limit = float(1 << 40)
    whole = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    checked = F.transform(x, lambda v: F.when(F.abs(v) * scale < limit, F.floor(v * scale)).otherwise(F.raise_error(F.lit("component too large")).cast("long")))
    return embeddings.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), checked.alias("terms"))
