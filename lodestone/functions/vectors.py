"""Distances between two array columns of one row, in double precision.

For ranking a whole table against query vectors use
``lodestone.operators.neighbours``: it works on blocks of rows at a time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - a.b / (|a||b|)``; null when a vector is zero or the widths differ."""
    distance = F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(F.size(a) == F.size(b), distance)


def l2_squared(a: Column, b: Column) -> Column:
    def squared(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.when(F.size(a) == F.size(b), _total(F.zip_with(a, b, squared)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))
