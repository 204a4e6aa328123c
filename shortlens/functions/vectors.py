"""Vector helpers on array columns, Column to Column. Arithmetic is in double whatever the stored type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def euclidean_sim(a: Column, b: Column) -> Column:
    return 1 - euclidean(a, b)


def to_vector(a: Column) -> Column:
    return array_to_vector(doubles(a))


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once per row, also where it is named inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2_normalize(a: Column) -> Column:
    """Unit length; a vector without length stays as it is."""

    def scaled(length: Column) -> Column:
        return F.when(length == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / length))

    return F.when(a.isNotNull(), bound_once(norm(a), scaled))


def argmax(a: Column) -> Column:
    """Index from 0 of the first largest value; null for an empty or null array."""
    return F.nullif(F.array_position(a, F.array_max(a)), F.lit(0)) - 1
