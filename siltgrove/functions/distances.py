"""Vector functions as Column expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; null if either vector is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


DISTANCES = {"cosine": cosine_distance, "l1": l1, "l2": l2, "linf": linf}


def normalized(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def score(distance: Column, metric: str) -> Column:
    """A similarity from a distance: (2 - d) / 2 for cosine, -d for the others."""
    return (2 - distance) / 2 if metric == "cosine" else -distance
