"""Values that several sets share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_at_least(sets: list[DataFrame], t: int = 0) -> DataFrame:
    """``value, n``: the values of ``t`` or more of the one-column tables (0: of all), and how many have them."""
    one = [df.select(F.col(f"`{df.columns[0]}`").alias("value"), F.lit(i).alias("i")).distinct() for i, df in enumerate(sets)]
    both = reduce(DataFrame.unionByName, one)
    return both.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= (t or len(sets)))
