"""Vector functions as Column expressions over arrays of doubles [M1-M3]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """[M2] 0 for empty vectors, unequal lengths and zero norms."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / F.when(n > 0, n)).otherwise(0.0)


def unit(a) -> Column:
    """[M1] a zero vector stays. The norm stands outside the lambda over components, which would take it again for each of them."""
    scaled = lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])
    return F.element_at(F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), scaled), 1)


def similarity_of_distance(d) -> Column:
    """[M3]"""
    return F.greatest(F.lit(0.0), 1 - F.coalesce(d, F.lit(1.0)))
