"""Vector arithmetic on array columns, in float64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_doubles(left), as_doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays zero.

    The norm enters as an array of its own, because Spark evaluates what a lambda refers
    to once per element. Pass a plain column: a computed vector is evaluated three times.
    """
    vector = as_doubles(vector)
    norm = F.greatest(F.sqrt(dot(vector, vector)), F.lit(1e-12))
    return F.zip_with(vector, F.array_repeat(norm, F.size(vector)), lambda x, n: x / n)
