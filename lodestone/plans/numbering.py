"""Consecutive numbers in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.shared import materialise


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with a number from 0 in ``order``: rows are sorted across partitions, each partition's count is summed (a row
    a partition), and a row gets its partition's start and its place there."""
    parts = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.join(F.broadcast(starts), "_p").withColumn(name, (place + F.col("_start")).cast("bigint")).drop("_p", "_start")
