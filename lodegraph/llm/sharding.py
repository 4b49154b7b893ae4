"""Contiguous shards of equal bytes by a global prefix sum.

Rows are ordered by (hash of the text, id), so that equal texts are neighbours.
A range partitioning gives every task a contiguous run of that order; each task
forms the prefix sums of its own run, the totals of the runs (one number for
each partition) give every run its offset, and the total is cut at equal
targets. No task sees more than its own run, and no text is shuffled.

A cut that falls inside a group of equal texts moves to the group's nearer edge
if that moves it by no more than the largest row; a larger group is cut where
the target falls, so that one text that fills a third of the table still gives
near-equal shards.

Defined cases: a null text has no bytes and counts as its overhead alone; a null
id sorts first; repeated rows are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import ship, shuffle_partitions, stored, whole_text

_RUNS = "doc_id long, size long, text_crc32 long, h long, run int, local_start long, local_row long"


def _prefix_sums(batches):
    """Within one sorted run: bytes and rows before each row."""
    from pyspark import TaskContext

    run, start, row = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column("size").to_numpy()
        ends = start + np.cumsum(size)
        n = len(size)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("doc_id", "size", "text_crc32", "h")), pa.array(np.full(n, run, np.int32)), pa.array(ends - size), pa.array(np.arange(row, row + n))],
            names=["doc_id", "size", "text_crc32", "h", "run", "local_start", "local_row"],
        )
        if n:
            start, row = int(ends[-1]), row + n


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: every row with its shard and its place in the shard."""
    spark = docs.sparkSession
    ship(spark)
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    runs = stored(
        rows.repartitionByRange(shuffle_partitions(spark), "h", "doc_id").sortWithinPartitions("h", "doc_id").mapInArrow(_prefix_sums, _RUNS),
        "runs",
    )
    # One row for each partition, never for each document.
    totals = runs.groupBy("run").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("most")).orderBy("run").collect()
    total, largest = sum(r["b"] for r in totals), max((r["most"] for r in totals), default=0)
    offsets, at_byte, at_row = [], 0, 0
    for r in totals:
        offsets.append((r["run"], at_byte, at_row))
        at_byte, at_row = at_byte + r["b"], at_row + r["n"]
    placed = runs.join(F.broadcast(spark.createDataFrame(offsets, "run int, b0 long, r0 long")), "run").select(
        "doc_id", "size", "text_crc32", "h", (F.col("b0") + F.col("local_start")).alias("start"), (F.col("r0") + F.col("local_row")).alias("row")
    )
    cuts = _cuts(placed, total, largest, n_shards)
    before = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c <= F.col("start"))) if cuts else F.lit(0)
    placed = placed.withColumn("shard", before.cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def _cuts(placed: DataFrame, total: int, largest: int, n_shards: int) -> list[int]:
    """The bytes at which shards 1, 2, ... begin: row edges next to the targets."""
    targets = [total * k // n_shards for k in range(1, n_shards)]
    if not total:
        return targets
    k = F.floor((F.col("start") + F.col("size")) * F.lit(n_shards) / F.lit(total))
    first_k = F.floor(F.col("start") * F.lit(n_shards) / F.lit(total))
    # Only rows that reach over a target: as many as there are shards.
    over = placed.where((k > first_k) & (F.col("start") < F.lit(total))).select("h", "start", "size")
    edges = over.collect()
    if not edges:
        return targets
    groups = {
        r["h"]: (r["a"], r["z"])
        for r in placed.where(F.col("h").isin([e["h"] for e in edges])).groupBy("h").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("z")).collect()
    }
    found = []
    for t in targets:
        row = next((e for e in edges if e["start"] <= t <= e["start"] + e["size"]), None)
        if row is None:
            found.append(t)
            continue
        near = min(groups[row["h"]], key=lambda x: abs(x - t))
        if abs(near - t) > largest:
            near = min((row["start"], row["start"] + row["size"]), key=lambda x: abs(x - t))
        found.append(near)
    return [max(found[: i + 1]) for i in range(len(found))]
