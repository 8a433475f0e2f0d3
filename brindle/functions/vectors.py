"""Expressions over ``array<double>`` columns and scalars; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm_squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.sqrt(norm_squared(a) * norm_squared(b))


def rbf(d2: Column, gamma: float) -> Column:
    return F.exp(d2 * -gamma)


def column_transform(v: Column, center: Sequence[float], scale: Sequence[float]) -> Column:
    """(x - center) * scale, position by position."""
    return F.zip_with(F.zip_with(v, literal(center), lambda x, c: x - c), literal(scale), lambda x, s: x * s)


def linear(v: Column, weights: Sequence[float], intercept: float) -> Column:
    return dot(v, literal(weights)) + F.lit(float(intercept))


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z), with z held within 100 of 0."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-100.0), F.least(F.lit(100.0), z))))


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / total(e))


def log_loss(z: Column, y: Column) -> Column:
    """Stable -log p of the label y (0 or 1) under the logit z."""
    t = F.when(y > 0, -z).otherwise(z)
    return F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))


def cross_entropy(p: Column, label: Column) -> Column:
    """-log of the probability at the label's position, which counts as 1e-7 at least."""
    return -F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-7), F.get(p, label))))


def soft_threshold(x: Column, t: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def argmax(v: Column) -> Column:
    """Position of the first largest value, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def argmin(v: Column) -> Column:
    return (F.array_position(v, F.array_min(v)) - 1).cast("int")


def matmul(v: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """The row vector times a small matrix (one row for each feature)."""
    return F.array(*[dot(v, literal(column)) for column in zip(*matrix, strict=True)])


def center(v: Column, mean: Sequence[float]) -> Column:
    return F.zip_with(v, literal(mean), lambda x, m: x - m)
