"""RDF text and dictionaries: parse, encode, append, decode, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.numbering import numbered

# A URI, a literal with its suffix, or a bare token.
_TERM = r'(<[^>]*>|"(?:[^"\\]|\\.)*"[^\s]*|[^\s]+)'
_LINE = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}\s*\.?\s*$"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """``s, p, o`` of every line that holds a triple."""
    found = lines.select(*(F.regexp_extract(column, _LINE, i + 1).alias(c) for i, c in enumerate(("s", "p", "o"))))
    return found.where("s <> '' and p <> '' and o <> ''")


def with_prefix(triples: DataFrame, prefix: str) -> DataFrame:
    """Triples whose predicate starts with the prefix."""
    return triples.where(F.col("p").startswith(prefix))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``id, term`` of ``id term`` lines."""
    line = spark.read.text(path)
    return line.select(F.substring_index("value", " ", 1).cast("long").alias("id"), F.regexp_extract("value", r"^\S+ (.*)$", 1).alias("term"))


def write_dictionary(dictionary: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted by id; ``mode='append'`` adds to what is there."""
    dictionary.orderBy("id").select(F.concat_ws(" ", F.col("id").cast("string"), "term").alias("value")).write.mode(mode).text(path)


def _terms(triples: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    term: Column = F.explode(F.array(*(F.col(c) for c in columns)))
    return triples.select(term.alias("term")).distinct()


def dictionaries(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids from 1 in the order of the terms: one dictionary for subjects and objects, one for predicates."""
    return tuple(numbered(_terms(triples, c), ["term"]).select("id", "term") for c in (("s", "o"), ("p",)))


def appended(triples: DataFrame, nodes: DataFrame, predicates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionaries with the new terms of ``triples``, numbered from the largest id on."""
    found = []
    for known, columns in ((nodes, ("s", "o")), (predicates, ("p",))):
        new = _terms(triples, columns).join(known, "term", "left_anti")
        most = known.agg(F.max("id")).first()[0] or 0
        found.append(known.select("id", "term").unionByName(numbered(new, ["term"], first=most + 1).select("id", "term")))
    return tuple(found)


def encoded(triples: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """Terms to ids; triples with a term that the dictionaries lack are left out."""
    s = nodes.select(F.col("term").alias("s"), F.col("id").alias("si"))
    p = predicates.select(F.col("term").alias("p"), F.col("id").alias("pi"))
    o = nodes.select(F.col("term").alias("o"), F.col("id").alias("oi"))
    return triples.join(p, "p").join(s, "s").join(o, "o").select(F.col("si").alias("s"), F.col("pi").alias("p"), F.col("oi").alias("o"))


def decoded(triples: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """Ids to terms."""
    s = nodes.select(F.col("id").alias("s"), F.col("term").alias("st"))
    p = predicates.select(F.col("id").alias("p"), F.col("term").alias("pt"))
    o = nodes.select(F.col("id").alias("o"), F.col("term").alias("ot"))
    return triples.join(p, "p").join(s, "s").join(o, "o").select(F.col("st").alias("s"), F.col("pt").alias("p"), F.col("ot").alias("o"))


def turtle(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat(F.concat_ws(" ", "s", "p", "o"), F.lit(" .")).alias("value"))
