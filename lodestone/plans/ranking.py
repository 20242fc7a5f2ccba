"""Ranks within keys, and names of column types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, key: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The n first rows of a key; Spark keeps n a partition before it shuffles. ``name`` counts from 0."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1).where(F.col(name) < n)


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
