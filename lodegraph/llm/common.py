"""Shared pieces: scratch tables in the cluster's shared folder, packed columns, file names."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.storage import discard, stored

#: Bytes of text that a task holds in its packed form at once.
CHUNK_BYTES = 6 << 20
#: Bytes of text for a bucket: no fewer than LEAST (many small buckets would send one another many small messages), no more than BYTES.
BUCKET_LEAST, BUCKET_BYTES = 4 << 20, 32 << 20

#: Bytes of an Arrow batch between the JVM and Python, unless the session sets them: long rows make small batches.
ARROW_BATCH_BYTES = 8 << 20
_ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


__all__ = ["buckets", "discard", "documents", "pack", "remainder", "ship", "shuffle_partitions", "stored", "tidied", "tidy", "unpack", "whole_text"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def buckets(texts: DataFrame, column: str = "text") -> int:
    """As many buckets as shuffles have partitions, within the bounds for a bucket's bytes: it lies in a task's memory."""
    total = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES), min(shuffle_partitions(texts.sparkSession), -(-total // BUCKET_LEAST)))


def whole_text(column: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as the text '')."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % F.lit(modulus)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Give freed memory back to the system. Python workers live on between tasks and would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidied(run):
    """``run`` for ``mapInArrow``; its worker's memory is tidied after each batch, and at the end of the task."""

    def wrapped(batches):
        try:
            for b in run(batches):
                yield b
                del b
                tidy()
        finally:
            tidy()

    return wrapped


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to one compressed blob; each array is split into byte planes, which compress better."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        parts += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    found, at = [], 1
    for _ in range(raw[0]):
        dtype = np.dtype(raw[at : at + 4].decode().strip())
        n = int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        found.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
        at += size
    return found


def ship(spark: SparkSession) -> None:
    """Make this package importable for the executors' Python workers, and bound the batches that they hold."""
    if spark.conf.get(_ARROW_BATCH, None) is None:
        spark.conf.set(_ARROW_BATCH, str(ARROW_BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_lodegraph_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodegraph-zip-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/lodegraph.zip", "w") as z:
        for p in (root / "lodegraph").rglob("*.py"):
            z.write(p, p.relative_to(root))
    sc.addPyFile(f"{folder}/lodegraph.zip")  # the driver serves it to the executors
    sc._lodegraph_shipped = True
