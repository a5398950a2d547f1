"""Vectors as arrays. Sums run in array order, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not for each element of an array in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def length(v: Column) -> Column:
    """The norm, and 1 for a zero vector."""
    return F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return _once(length(v), lambda n: F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, with the length of a zero vector as 1."""
    both = F.struct(doubles(a).alias("a"), doubles(b).alias("b"))
    return _once(both, lambda s: dot(s["a"], s["b"]) / (length(s["a"]) * length(s["b"])))


def total(vectors: Column) -> Column:
    """The sum of an array of vectors, in its order."""
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(vectors, zero, lambda all_, v: F.zip_with(all_, v, lambda a, b: a + b))
