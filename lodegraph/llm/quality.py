"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built from a bounded sample of labelled texts. A text is
compressed with each of them, in pieces short enough for the dictionary to
matter throughout; the normalised difference of the two sizes says which class
the text resembles, and the compression ratio tells apart texts that repeat
themselves. Sizes of short texts say less, so their length weighs the difference.
A logistic calibration, fitted on sampled texts that the
dictionaries have not seen and weighted to the labels' own proportions, turns
both into the probability of label 1.

Scoring is one pass without a shuffle. What is fitted are two dictionaries of
``DICTIONARY_BYTES`` and six numbers.

Defined cases: a null or empty text compresses to nothing (difference and ratio
0) and gets the calibrated score of that; very long texts are compressed whole,
piece by piece; repeated rows are scored each; without labelled rows of both
classes every score is 0.5, or the one class's share; an empty table gives an
empty result; labels, language, source and id never enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.llm.common import ship, tidied, whole_text
from lodegraph.llm.sampling import order, sampled_ids

#: Labelled documents of each class in the sample, and bytes of their texts: documents are taken whole, in the order of their
#: hashes, until either bound is reached (documented bounds).
SAMPLE_DOCUMENTS = 1200
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 112 << 10
PIECE_BYTES = 2048
LEVEL = 3
#: A text counts as good from this score on.
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    found = []
    for raw in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(raw)
        dictionary.precompute_compress(level=LEVEL)
        found.append(zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return found


def sizes(text: str, good: bytes, bad: bytes) -> tuple[int, int, int]:
    """Bytes of the text, and compressed with the good and with the bad dictionary."""
    raw = text.encode("utf-8", "surrogatepass")
    a, b = _compressors(good, bad)
    pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
    return len(raw), sum(len(a.compress(p)) for p in pieces), sum(len(b.compress(p)) for p in pieces)


def features(found: np.ndarray) -> np.ndarray:
    """1, difference, ratio and their products, from rows of :func:`sizes`."""
    n, a, b = found.T.astype(float)
    d = (b - a) / np.maximum(a + b, 1)
    r = np.minimum(a, b) / np.maximum(n, 1)
    short = 1 / np.sqrt(1 + n / 100)
    return np.stack([np.ones_like(d), 10 * d, r, r * r, short, 10 * d * short], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (weight * (p - y)) + 1e-3 * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], totals: dict[int, int]) -> Model:
    """Dictionaries from two thirds of the sample, calibration from the rest."""
    share = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
    if len(set(labels)) < 2:
        logit = 0.0 if not labels else float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Model(b"", b"", (logit, 0, 0, 0, 0, 0))
    built = {}
    for label in (1, 0):
        raw = [t.encode("utf-8", "surrogatepass") for i, (t, y) in enumerate(zip(texts, labels)) if y == label and i % 3]
        pieces = [t[i : i + PIECE_BYTES] for t in raw for i in range(0, len(t), PIECE_BYTES)]
        try:
            built[label] = zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few pieces to train on: the text itself is the dictionary
            built[label] = b"".join(pieces)[-DICTIONARY_BYTES:] or b" " * 8
    held = [i for i in range(len(texts)) if i % 3 == 0] if len(set(labels[::3])) == 2 else list(range(len(texts)))
    y = np.array([labels[i] for i in held], float)
    x = features(np.array([sizes(texts[i], built[1], built[0]) for i in held]))
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    return Model(built[1], built[0], tuple(_logistic(x, y, weight)))


def train(docs: DataFrame, labels: DataFrame, learnable, bound: int = SAMPLE_DOCUMENTS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of the labelled documents for which ``learnable`` (a condition on ``doc_id``) holds.

    An id with both labels counts as bad; of rows that repeat an id the one with the shortest text counts, and of these
    the one that comes first by hash.
    """
    labelled = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learnable).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in labelled.groupBy("id").agg(F.min("label").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = sampled_ids(labelled, bound)  # at most 2 * bound rows, so it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text("text").alias("text"))
    sizes_ = texts.select("id", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash")).join(F.broadcast(ids), "id")
    first = sizes_.groupBy("id", "label").agg(F.min(F.struct("bytes", "hash")).alias("row")).select("id", "label", "row.bytes", "row.hash")
    before = F.sum("bytes").over(Window.partitionBy("label").orderBy(*order()).rowsBetween(Window.unboundedPreceding, 0))  # of at most ``bound`` rows
    chosen = first.withColumn("so_far", before).where(F.col("so_far") <= most_bytes).select("id", "label", "hash")
    found = (
        texts.withColumn("hash", F.xxhash64("text"))
        .join(F.broadcast(chosen), ["id", "hash"])
        .dropDuplicates(["id"])  # rows of equal id and text
        .select("text", "label", *(c.alias(f"o{i}") for i, c in enumerate(order())))
        .orderBy("o0", "o1")
        .collect()
    )
    return fit([r["text"] for r in found], [r["label"] for r in found], totals)


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with one more column, ``__quality``: the probability of label 1."""
    ship(docs.sparkSession)

    def run(batches):
        w = np.array(model.weights)
        for b in batches:
            texts = b.column("text").to_pylist()
            if model.good:
                found = np.array([sizes(t or "", model.good, model.bad) for t in texts]).reshape(-1, 3)
                z = features(found) @ w
            else:
                z = np.full(len(texts), w[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=[*b.schema.names, "__quality"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField("__quality", DoubleType())]))
