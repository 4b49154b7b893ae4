"""The k-nearest-neighbour graph: exact construction, truncation, inverse, symmetric closure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors in a block at most; a task compares two blocks, and a vector is sent once for each block of the other side.
BLOCK = 1 << 16
#: Distances that are held at once.
_CELLS = 1 << 21
_BEST = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("dd", pa.int64())])


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 10_000) -> DataFrame:
    """``id, v``: ids from 1, components floor(scale * x), so that distances are exact integers."""
    return embeddings.select((F.col(id_col) + 1).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def build(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Exact ``src, dst, rank`` by squared Euclidean distance, ties to the smaller id.

    Every pair of blocks is one task's work, with its own k best for each source;
    a window merges them. Rows travel in blocks, never as pairs.
    """
    spark = vectors.sparkSession
    enough = int(np.ceil(np.sqrt(spark.sparkContext.defaultParallelism)))  # every core gets a pair of blocks
    n = max(1, -(-vectors.count() // block), enough)
    dealt = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    sides = (
        dealt.select(F.col("b").alias("sb"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("db"), F.lit(True).alias("is_source"), "id", "v")
        .unionByName(dealt.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sb"), F.col("b").alias("db"), F.lit(False).alias("is_source"), "id", "v"))
    )

    def cell(table: pa.Table) -> pa.Table:
        is_source = table.column("is_source").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        values = table.column("v").combine_chunks()
        v = values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)
        if not is_source.any() or is_source.all():
            return _BEST.empty_table()
        src, a = ids[is_source], v[is_source]
        order = np.argsort(ids[~is_source], kind="stable")
        dst, b = ids[~is_source][order], v[~is_source][order]
        return nearest(src, a, dst, b, k)

    best = sides.groupBy("sb", "db").applyInArrow(cell, "src long, dst long, dd long")
    return ranked(best, "src", ["dd", "dst"], k).select("src", "dst", "rank")


def nearest(src: np.ndarray, a: np.ndarray, dst: np.ndarray, b: np.ndarray, k: int) -> pa.Table:
    """The k nearest targets of every source; targets ascend, so that the first of equal distances is the smallest id."""
    # Products of doubles are exact up to 2**53; larger components use integers.
    most = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))) ** 2 * 4 * max(1, a.shape[1])
    if most * (len(dst) + 1) >= 2**63:
        raise ValueError("distances do not fit into 64 bits")
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    af, bf = (a.astype(float), b.astype(float).T) if most < 2**53 else (a, b.T)
    m, width, found = len(dst), min(k, len(dst)), []
    step = max(1, _CELLS // m)
    for at in range(0, len(src), step):
        dd = a2[at : at + step, None] + b2[None, :] - 2 * (af[at : at + step] @ bf).astype(np.int64)
        # Distance and place in one number: distinct, in the order of (distance, id).
        key = dd * m + np.arange(m)
        me = src[at : at + step, None]
        key[dst == me] = np.iinfo(np.int64).max  # no neighbour of itself
        if width < m:
            key = np.partition(key, width - 1, axis=1)[:, :width]
        kept = key != np.iinfo(np.int64).max
        found.append((np.broadcast_to(me, key.shape)[kept], dst[(key % m)[kept]], (key // m)[kept]))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], schema=_BEST)


def ranked(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each key; Catalyst keeps only these before and after the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def truncated(pairs: DataFrame, k: int) -> DataFrame:
    """First k of each list of ``n1, n2, pos`` (nearest first); short lists stay short."""
    return ranked(pairs.select(F.col("n1").alias("src"), F.col("n2").alias("dst"), "pos"), "src", ["pos", "dst"], k).select("src", "dst", "rank")


def symmetric(pairs: DataFrame, k: int) -> DataFrame:
    """From ``e1, e2, dist``: each pair enters both lists, nearest first, up to k."""
    both = pairs.select(F.col("e1").alias("src"), F.col("e2").alias("dst"), "dist").unionByName(pairs.select(F.col("e2").alias("src"), F.col("e1").alias("dst"), "dist"))
    return ranked(both.groupBy("src", "dst").agg(F.min("dist").alias("dist")), "src", ["dist", "dst"], k).select("src", "dst", "rank")


def inverse(knn: DataFrame) -> DataFrame:
    """``dst, pos, src``: the sources of every target by (rank, id)."""
    pos = F.row_number().over(Window.partitionBy("dst").orderBy("rank", "src"))
    return knn.select("dst", pos.alias("pos"), "src", "rank")


def fused(knn: DataFrame) -> DataFrame:
    """``src, dst, rank_fwd, rank_bwd`` of mutual neighbours."""
    back = knn.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rank").alias("rank_bwd"))
    return knn.withColumnRenamed("rank", "rank_fwd").join(back, ["src", "dst"])
