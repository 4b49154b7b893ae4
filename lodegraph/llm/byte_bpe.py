"""Byte-level BPE encoding and decoding by a corpus-wide shuffle of distinct words.

1. A task splits whole texts into pre-tokens and explodes them with their
   positions; a chunk keeps every distinct pre-token once and, for each
   position, the number of its pre-token.
2. The distinct pre-tokens are shuffled by hash. A bucket merges each distinct
   word of the corpus once, whatever its count.
3. The identifiers go back to the chunks, where the positions reassemble the
   documents.
4. Decoding joins identifiers with the table of token bytes, which has as many
   rows as the vocabulary and so a fixed size.

One exchange carries the positions (keyed by chunk) and the distinct words
(keyed by bucket); both consumers read it.

Defined cases: a null or empty text has no identifiers and decodes to no bytes;
texts of any length are encoded whole; repeated rows are encoded each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import buckets, pack, ship, tidy, unpack, whole_text
from lodegraph.llm.packed import Numbers, chunks, dealt, gathered, rows

_SENT = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_DDL = "key int, kind int, chunk long, blob binary"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of token bytes: all bytes, and each identifier's start and length."""
    table = ranks(path)
    most = max(table.values()) + 1
    by_id = [b""] * most
    for token, i in table.items():
        by_id[i] = token
    lengths = np.fromiter(map(len, by_id), np.int64, most)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lengths) - lengths, lengths


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    flat, starts, lengths = token_bytes(path)
    return gathered(flat, starts, lengths, ids).tobytes()


def _split(batches, pattern: str, n_buckets: int):
    compiled = regex.compile(pattern)
    for key, held in chunks(batches, ("doc_id", "text"), "text"):
        numbers = Numbers()
        docs = [np.fromiter(map(numbers.__getitem__, compiled.findall(t)), np.int32) for t in held["text"]]
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        words = [w.encode("utf-8", "surrogatepass") for w in numbers]
        # Frequent words get small numbers, which pack well.
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        bucket = np.fromiter((zlib.crc32(words[i]) % n_buckets for i in order), np.int32, len(words))
        ids = np.array([-1 if d is None else d for d in held["doc_id"]], np.int64)
        known = np.array([d is not None for d in held["doc_id"]], np.uint8)
        sent = [(key, 0, key, pack(ids, known, counts, rank[flat], bucket))]
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
        for part in np.split(by_bucket, edges[1:]) if len(words) else []:
            own = [words[order[i]] for i in part]
            lengths = np.fromiter(map(len, own), np.uint32, len(own))
            sent.append((int(bucket[part[0]]), 1, key, pack(lengths, np.frombuffer(b"".join(own), np.uint8))))
        del docs, flat, words, numbers
        for at in range(0, len(sent), 64):
            yield from rows(_SENT, sent[at : at + 64]).to_batches()


def _encode_bucket(table: pa.Table, path: str, pattern: str) -> pa.Table:
    """Each distinct word of a bucket is encoded once; every chunk gets its words' identifiers."""
    tidy()
    enc, seen, sent = encoding(path, pattern), {}, []
    for kind, chunk, blob, bucket in zip(*(table.column(c).to_pylist() for c in ("kind", "chunk", "blob", "key"))):
        if kind != 1:
            continue
        lengths, flat = unpack(blob)
        raw, at, found = flat.tobytes(), 0, []
        for n in lengths.tolist():
            word = raw[at : at + n]
            at += n
            ids = seen.get(word)
            if ids is None:
                ids = seen[word] = enc.encode_ordinary(word.decode("utf-8"))
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.uint32, len(found))
        merged = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        sent.append((chunk, 2, bucket, pack(sizes, merged)))
    return rows(_SENT, sent)


def _reassemble(positions: pa.Table, answers: pa.Table, path: str) -> pa.Table:
    tidy()
    held = [b for k, b in zip(positions.column("kind").to_pylist(), positions.column("blob").to_pylist()) if k == 0]
    if not held:
        return _OUT.empty_table()
    ids, known, counts, flat, bucket = unpack(held[0])
    lengths, starts, parts, at = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64), [], 0
    by_bucket = np.argsort(bucket, kind="stable")
    low, high = np.searchsorted(bucket[by_bucket], np.arange(bucket.max(initial=-1) + 1), "left"), np.searchsorted(bucket[by_bucket], np.arange(bucket.max(initial=-1) + 1), "right")
    for b, blob in zip(answers.column("chunk").to_pylist(), answers.column("blob").to_pylist()):
        sizes, merged = unpack(blob)
        which = by_bucket[low[b] : high[b]]
        lengths[which] = sizes
        starts[which] = at + np.cumsum(sizes, dtype=np.int64) - sizes
        parts.append(merged)
        at += len(merged)
    merged = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    found, done = [], 0
    for d, k, n in zip(ids.tolist(), known.tolist(), counts.tolist()):
        own = gathered(merged, starts, lengths, flat[done : done + n])
        done += n
        found.append((d if k else None, len(own), own.astype("<u4").tobytes(), decode_ids(own, path)))
    return rows(_OUT, found)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) and ``decoded`` (bytes) of every row."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    n = buckets(texts)
    sent = dealt(texts.mapInArrow(lambda b: _split(b, pattern, n), _DDL), n)
    answers = dealt(sent.groupBy("key").applyInArrow(lambda t: _encode_bucket(t, vocabulary, pattern), _DDL), n)
    return (
        sent.groupBy("key")
        .cogroup(answers.groupBy("key"))
        .applyInArrow(lambda p, a: _reassemble(p, a, vocabulary), "doc_id long, n_tokens long, ids binary, decoded binary")
    )
