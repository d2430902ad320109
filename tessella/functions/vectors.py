"""Vectors as array<double> columns, and a way to bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, guard: float = 0.0) -> Column:
    """v at length one; null for a zero vector unless a guard is added to its length."""
    length = norm(v) + F.lit(guard)
    return let(length, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(v: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return F.transform(v, lambda x: x * k)


def cosine(a: Column, b: Column) -> Column:
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n))


def mean_vector(v: Column) -> Column:
    """The element-wise mean over a group: partial sums per task, one array per group shuffled."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def sum_vector(v: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def angle(a: Column, b: Column) -> Column:
    """Degrees between two unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))
