"""From raw documents to token identifiers: five stages over whole tables.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept. All but the last return the columns of ``docs`` unchanged in
name and order. Column names with two leading underscores are internal.

Defined cases: empty tables give empty results; a row is known by its id and its
text, so rows that repeat an id, or have none, are judged by their own texts; of
a group of linked rows the one with the smallest id stays (rows without an id
come last), of rows with equal id and text one; other columns are carried
through; a column name with two leading underscores is an error.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import byte_bpe, decontaminate, jaccard_join, quality, surrogates
from lodegraph.llm.common import discard, ship, stored

#: Rows up to which a list of rejected documents (two numbers each, some 100 bytes as a hashed row) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1 << 17
#: Key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = b"lodegraph corpus pipeline"


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows of given ``__id`` and ``__hash`` of the text."""
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, _is(docs), "left_anti").select(*docs.columns)


def _hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _is(docs: DataFrame):
    return (_hash(docs) == F.col("__hash")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__id"))


def _checked(docs: DataFrame) -> DataFrame:
    if clash := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"columns with two leading underscores: {clash}")
    return docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    ship(spark)
    model = quality.train(_checked(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.score_rows(docs, model).where(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    ship(spark)
    joined = jaccard_join.join(_checked(docs), percent=80, shingle=5, members=True).where("cluster is not null")
    rows = stored(joined.groupBy("cluster", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("copies")), "joined")
    first = rows.groupBy("cluster").agg(F.min(F.struct(F.isnull("__id").alias("nameless"), "__id", "__hash")).alias("first")).select("cluster", F.col("first.__id").alias("i"), F.col("first.__hash").alias("t"))
    placed = rows.join(first, "cluster").withColumn("stays", F.col("__id").eqNullSafe(F.col("i")) & (F.col("__hash") == F.col("t")))
    kept = _without(docs, stored(placed.where("not stays").select("__id", "__hash").distinct(), "dropped"))
    repeated = stored(placed.where("stays and copies > 1").select("__id", "__hash").distinct(), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, _is(kept), "left_semi").select(*kept.columns, _hash(kept).alias("__h")).dropDuplicates(["doc_id", "__h"]).drop("__h")
    return _without(kept, repeated).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.find(_checked(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=80, shingle=5)
    return _without(docs, stored(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "held"))


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates."""
    ship(spark)
    replaced = surrogates.replace(_checked(docs), SURROGATE_KEY).drop("__n_mentions")
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return replaced.select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) and digests of the ids and of the decoded bytes."""
    ship(spark)
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII surrogates", surrogate_stage),
    ("byte-level BPE", encoding_stage),
]

#: Compression and byte-pair merging have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
