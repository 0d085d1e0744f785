"""Vector columns on ``array<float>``: distances and normalisation, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivano.functions.bind import let

METRICS = ("sqeuclidean", "cosine", "ip")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    def term(x, y):
        return F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))

    return _fold(F.zip_with(a, b, term))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos``; a zero vector has distance 1 to everything."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, F.lit(1.0) - dot(a, b) / lengths).otherwise(F.lit(1.0))


def inner_product_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def distance(a: Column, b: Column, metric: str = "sqeuclidean") -> Column:
    """Distance as the store reports it: single precision, widened to double."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")
    value = {
        "sqeuclidean": squared_l2,
        "cosine": cosine_distance,
        "ip": inner_product_distance,
    }[metric](a, b)
    return value.cast("float").cast("double")


def l2_normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays zero."""

    def scaled(v, length):
        unit = F.transform(v, lambda x: (x.cast("double") / length).cast("float"))
        return F.when(length > 0, unit).otherwise(v)

    return let(a, lambda v: let(norm(v), lambda length: scaled(v, length)))
