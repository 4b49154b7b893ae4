"""Chunks: packed runs of documents that meet a corpus-wide table of distinct items.

Exploding every token of a corpus into a row costs a shuffle of many times the
text. Here a task explodes the tokens of a chunk of whole documents in memory,
keeps each distinct item once with the positions pointing at it, and sends the
distinct items to buckets by hash. A bucket sees each item of the corpus once
for each chunk that has it, so a word that fills a third of all rows is no
larger there than any other. Answers go back to the chunks, where the
positions put them together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import CHUNK_BYTES, tidy

#: Keys of chunks are negative, those of buckets are not. Two chunks of a task lie so far apart; no job has as many tasks in a stage.
TASKS = 1_000_003


def chunks(batches, columns: tuple[str, ...], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, dict[str, list]]]:
    """``(chunk key, columns)`` with at most ``limit`` bytes of text each, or one longer text."""
    from pyspark import TaskContext

    key, held, size = -1 - TaskContext.get().partitionId(), {c: [] for c in columns}, 0
    if key < -TASKS:
        raise ValueError("too many tasks in a stage")
    for b in batches:
        values, sizes = {c: b.column(c).to_pylist() for c in columns}, pc.binary_length(b.column(text)).to_pylist()
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                yield key, held
                key, held, size = key - TASKS, {c: [] for c in columns}, 0
                tidy()
            for c in columns:
                held[c].append(values[c][i])
            size += n
        del values
    if held[columns[0]]:
        yield key, held
    del held
    tidy()


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Rows in the partition that their ``key`` names: buckets one each, chunks in turn, so that no partition gets several by chance."""
    return df.repartitionById(n, F.col("key"))


class Numbers(dict):
    """Words to numbers in order of first appearance."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of a ragged array, one after the other."""
    n = lengths[which]
    return flat[np.repeat(starts[which], n) + ragged(n)]


def rows(schema: pa.Schema, found: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)
