"""Text files of triples, neighbour lists, queries and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated ``s p o`` lines; distinct, so a repeated last line does no harm."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(*(parts[i].cast("long").alias(c) for i, c in enumerate(("s", "p", "o")))).dropDuplicates()


def write_triples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o").alias("value")).write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, line``: the lines of text files, numbered from 1.

    There is no global sort: the splits of the files, in order of file and offset,
    get offsets from their line counts (a row for each split).
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("file", "block").collect()
    offsets, done = [], 0
    for r in splits:
        offsets.append((r["file"], r["block"], done + 1 - r["first"]))
        done += r["n"]
    base = F.broadcast(spark.createDataFrame(offsets, "file string, block long, shift long"))
    return lines.join(base, ["file", "block"]).select("value", (F.col("at") + F.col("shift")).alias("line"))


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """Line i holds the neighbours of node i, nearest first; zeros are padding."""
    numbered = numbered_lines(spark, path).select(F.col("line").alias("src"), F.split(F.trim("value"), r"\s+").alias("list"))
    return (
        numbered.select("src", F.posexplode("list").alias("pos", "dst"))
        .where("dst <> '' and dst <> '0'")
        .select("src", F.col("dst").cast("long").alias("dst"), (F.col("pos") + 1).cast("int").alias("rank"))
    )


def write_neighbours(knn: DataFrame, nodes: DataFrame, path: str) -> None:
    """One line for each node of ``nodes`` (ids 1, 2, ... without gaps), in order."""
    lists = knn.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("l"))  # k entries at most
    lines = nodes.join(lists, nodes["id"] == lists["src"], "left").select("id", F.concat_ws(" ", F.transform(F.coalesce("l", F.array()), lambda x: x["dst"].cast("string"))).alias("value"))
    lines.orderBy("id").select("value").write.text(path)


def read_queries(path: str) -> list[tuple[int, str]]:
    """Numbered non-empty lines of a query file on the driver's file system."""
    from lodegraph.plans.parser import parse_lines

    with open(path, encoding="utf-8") as f:
        return parse_lines(f)


def formatted(df: DataFrame) -> DataFrame:
    """One text line for each result: ``?x=1 ?y=2``."""
    return df.select(F.concat_ws(" ", *(F.concat(F.lit(f"?{c}="), F.col(f"`{c}`").cast("string")) for c in df.columns)).alias("value"))


def write_result(df: DataFrame, path: str) -> None:
    formatted(df).write.text(path)


def stats_line(number: int, results: int | None, nanoseconds: int) -> str:
    """``number;results;nanoseconds``; results are empty where the query took too long."""
    return f"{number};{'' if results is None else results};{nanoseconds}"
