"""Array expressions on ARRAY<DOUBLE> columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def square_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def unit(v: Column, eps: float = 1e-12) -> Column:
    """v divided by its length, the length floored at ``eps``."""
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.transform(v, lambda x: x / size)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values) -> Column:
    """A vector (or, nested, a matrix) of Python numbers as a literal."""
    return F.array(*[literal(v) if hasattr(v, "__len__") else F.lit(float(v)) for v in values])


def times_vector(matrix: Column, v: Column) -> Column:
    """Matrix (array of rows) times vector."""
    return F.transform(matrix, lambda row: dot(row, v))


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def mean_vector(column: str, dims: int) -> Column:
    """Aggregate: the component-wise mean; partial sums combine map-side."""
    return F.array(*[F.avg(F.get(column, F.lit(i))) for i in range(dims)])


def sum_vector(column: str, dims: int) -> Column:
    """Aggregate: the component-wise sum."""
    return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(dims)])
