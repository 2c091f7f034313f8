"""Vector metrics as columns: smaller is nearer for every one of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParam

METRICS = ("euclidean", "manhattan", "dot", "cosine", "angular")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; null for a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Squared Euclidean, Manhattan, negated inner product, negated cosine, or 2 - 2 cosine (2 for a zero vector)."""
    if metric == "euclidean":
        return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)))
    if metric == "dot":
        return -dot(a, b)
    if metric == "cosine":
        return -cosine_similarity(a, b)
    if metric == "angular":
        return F.coalesce(2 - 2 * cosine_similarity(a, b), F.lit(2.0))
    raise InvalidParam(f"metric {metric!r}: one of {METRICS}")


def range_distance(a: Column, b: Column, start: int, end: int, metric: str = "euclidean") -> Column:
    """The metric over dimensions start (from 0) up to, not with, end."""
    return distance(F.slice(a, start + 1, end - start), F.slice(b, start + 1, end - start), metric)


def is_valid(v: Column, dimension: int | None = None) -> Column:
    """Whether a vector is there, of the given dimension, and free of null, NaN and infinite elements."""
    ok = v.isNotNull() & ~F.exists(_doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(ok & (F.size(v) == dimension) if dimension is not None else ok, F.lit(False))


def parse_vector(text: Column) -> Column:
    """A vector from its JSON text, null where that is none."""
    return F.from_json(text, "array<float>")


def split_imbalance(left: Column, right: Column) -> Column:
    """How uneven a split into two counts is: 0.5 is even, 1 is one-sided."""
    total = (left + right).cast("double")
    return F.when(total > 0, F.greatest(left, right) / total).otherwise(1.0)
