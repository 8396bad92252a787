"""Vector expressions over array<float>, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    def off(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, off), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, form: str = "l2_squared") -> Column:
    squared = l2_squared(a, b)
    return squared if form == "l2_squared" else F.sqrt(squared)
