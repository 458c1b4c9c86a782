"""Operators on edges: functions of both endpoints, softmax over a receiver's
edges, and sums back to nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import pointwise as P
from tessera.skew import dealt_join

#: The softmax's bounds: exponentials are clamped, row sums begin at the small value.
CLAMP, SEED = 1e12, 1e-12


def endpoints(edges: DataFrame, left: DataFrame, right: DataFrame, value: str = "s") -> DataFrame:
    """edges with ``l`` of the receiver and ``r`` of the sender."""
    a = left.select(F.col("id").alias("dst"), F.col(value).alias("l"))
    b = right.select(F.col("id").alias("src"), F.col(value).alias("r"))
    return dealt_join(dealt_join(edges, a, "dst"), b, "src")


def apply(edges: DataFrame, left: DataFrame, right: DataFrame, f: Callable[[Column, Column], Column], value: str = "s") -> DataFrame:
    """(dst, src, w): any function of both endpoints' values."""
    return endpoints(edges.select("dst", "src"), left, right, value).select("dst", "src", f(F.col("l"), F.col("r")).alias("w"))


def sddmm_sum(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return apply(edges, left, right, lambda a, b: a + b)


def sddmm_mul(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return apply(edges, left, right, lambda a, b: a * b)


def sddmm_dot(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The dot product of both endpoints' vectors."""
    return apply(edges, left, right, P.dot, "vec")


def leaky_relu(weights: DataFrame, slope: float = P.EDGE_SLOPE) -> DataFrame:
    return weights.withColumn("w", P.leaky_relu(F.col("w"), slope))


def edge_to_node(weights: DataFrame, seed: float = 0.0, by: str = "dst") -> DataFrame:
    """(id, s): the sum of each receiver's (or sender's) edge values."""
    return weights.groupBy(F.col(by).alias("id")).agg((F.lit(seed) + F.sum("w")).alias("s"))


def node_to_edge(weights: DataFrame, scalars: DataFrame, f: Callable[[Column, Column], Column] = lambda w, s: w * s) -> DataFrame:
    """Edge values combined with the receiver's scalar."""
    return dealt_join(weights, scalars.select(F.col("id").alias("dst"), "s"), "dst").select("dst", "src", f(F.col("w"), F.col("s")).alias("w"))


def softmax(weights: DataFrame, stable: bool = False) -> DataFrame:
    """exp(w), clamped, over the receiver's sum of these.

    Sums are a group-by (combined before the shuffle) joined back, so that a
    receiver of very many edges is a hot join key, which ``dealt_join`` lets
    adaptive execution split, and no window.  ``stable``
    first subtracts the receiver's largest value.
    """
    if stable:
        top = weights.groupBy(F.col("dst").alias("id")).agg(F.max("w").alias("s"))
        weights = node_to_edge(weights, top, lambda w, s: w - s)
    ex = weights.select("dst", "src", P.clamp(F.exp("w"), 0.0, CLAMP).alias("w"))
    return node_to_edge(ex, edge_to_node(ex, SEED), lambda w, s: w / s)


def softmax_grad(alpha: DataFrame, grad: DataFrame) -> DataFrame:
    """Of a softmax with outputs ``alpha`` and their gradient: sds - alpha * sum(sds).
    A gradient that carries the outputs as a column ``alpha`` is not joined with them."""
    if "alpha" in grad.columns:
        both = grad.select("dst", "src", F.col("alpha").alias("w"), F.col("w").alias("g"))
    else:
        both = alpha.join(grad.select("dst", "src", F.col("w").alias("g")), ["dst", "src"])
    sds = both.select("dst", "src", "w", (F.col("w") * F.col("g")).alias("sds"))
    total = sds.groupBy("dst").agg(F.sum("sds").alias("total"))
    return dealt_join(sds, total, "dst").select("dst", "src", (F.col("sds") - F.col("w") * F.col("total")).alias("w"))


def sddmm_sum_grad(grad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gradients of both scalars of ``sddmm_sum``: sums by receiver and by sender."""
    return edge_to_node(grad), edge_to_node(grad, by="src")


def sddmm_mul_grad(grad: DataFrame, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gradients of both scalars of ``sddmm_mul``: sums of the gradient times the
    other end's scalar."""
    both = endpoints(grad.select("dst", "src", "w"), left, right)
    own = lambda x: both.select("dst", "src", (F.col("w") * F.col(x)).alias("w"))
    return edge_to_node(own("r")), edge_to_node(own("l"), by="src")
