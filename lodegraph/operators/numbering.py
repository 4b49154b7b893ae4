"""Dense numbers for ordered values without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.storage import stored


def numbered(values: DataFrame, order: list[str], name: str = "id", first: int = 1) -> DataFrame:
    """``values`` with 1, 2, ... in the order of the given columns, which must be distinct.

    A range partitioning gives every task a run of the order; the runs' counts (one
    number for each partition) give every run its offset.
    """
    spark = values.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = stored(values.repartitionByRange(n, *order).withColumn("__run", F.spark_partition_id()), "runs")
    offsets, at = [], first - 1
    for r in runs.groupBy("__run").count().orderBy("__run").collect():
        offsets.append((r["__run"], at))
        at += r["count"]
    place = F.row_number().over(Window.partitionBy("__run").orderBy(*order))
    base = spark.createDataFrame(offsets, "__run int, __base long")
    return runs.withColumn("__place", place).join(F.broadcast(base), "__run").withColumn(name, F.col("__base") + F.col("__place")).select(*values.columns, name)
