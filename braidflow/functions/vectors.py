"""Arithmetic on ARRAY<DOUBLE> columns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(col: Column | str) -> Column:
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def literal(values: Iterable[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def total(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """The sum of products; vectors of different widths are an error."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different widths"))).otherwise(total(F.zip_with(a, b, lambda x, y: x * y)))


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sqdist(a, b))


def mean_vector(col: str, dims: int) -> Column:
    """The mean of vectors of a known width: one aggregate for each place, so nothing is exploded."""
    return F.array(*(F.avg(F.col(col)[k]) for k in range(dims)))


def rounded(col: Column, digits: int = 6) -> Column:
    return F.transform(col, lambda x: F.round(x, digits))
