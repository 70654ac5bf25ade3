"""Vector arithmetic on arrays of doubles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mix(a: Column, b: Column, alpha: float) -> Column:
    """(1 - alpha) a + alpha b."""
    return F.zip_with(a, b, lambda x, y: x * (1 - alpha) + y * alpha)


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def length(a: Column) -> Column:
    """The Euclidean norm."""
    return F.sqrt(dot(a, a))


def mean_length(*tables: DataFrame) -> DataFrame:
    """One row ``mean_norm``: the mean norm of the vectors ``f`` of all tables together."""
    every = tables[0].select("f")
    for t in tables[1:]:
        every = every.unionByName(t.select("f"))
    return every.agg(F.avg(length(F.col("f"))).alias("mean_norm"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a, b)
