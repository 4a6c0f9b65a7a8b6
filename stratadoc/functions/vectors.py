"""Column functions on vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stratadoc.functions.text import col


def as_double(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of products in index order, so that the result does not depend on the engine."""
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalise(v) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def present(v) -> Column:
    return col(v).isNotNull() & (F.size(col(v)) > 0)
