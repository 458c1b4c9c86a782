"""Pointwise functions: Column to Column, for scalars; ``on`` lifts them to vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slope of the activation on edge values, and of the one on node values.
EDGE_SLOPE, NODE_SLOPE = 0.2, 0.01


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def leaky_relu(x: Column, slope: float = EDGE_SLOPE) -> Column:
    return F.when(x >= 0, x).otherwise(x * F.lit(slope))


def exp_leaky_relu(x: Column, slope: float = NODE_SLOPE) -> Column:
    return F.exp(leaky_relu(x, slope))


def inverse_root(x: Column) -> Column:
    """sqrt(1 / x); null where x is 0 or less."""
    return F.when(x > 0, F.sqrt(F.lit(1.0) / x))


def power(x: Column, p: float) -> Column:
    return F.pow(x, F.lit(float(p)))


def scale_by_eps(x: Column, eps: float = 1.0) -> Column:
    return F.lit(1.0 + eps) * x


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def reciprocal(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x)


def divide(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(a, b)


def wsum(acc: Column, w: Column, x: Column) -> Column:
    return acc + w * x


def log_softmax(vec: Column) -> Column:
    """Of a vector: x - log(sum(exp(x))), around its largest value."""
    top = F.array_max(vec)
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(vec, lambda x: x - top - F.log(total))


def on(vec: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` on every value of a vector; its defaults are not taken for an index."""
    return F.transform(vec, lambda x: f(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)
