"""Operators on nodes: degrees, scales, neighbourhood aggregation, dense layers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import pointwise as P
from tessera.graph import Graph
from tessera.operators import grid
from tessera.skew import dealt_join

#: Vectors up to this width are aggregated as columns of one group-by, wider ones in chunks of it.
WIDE = 64
#: Weight matrices up to this many cells are literals of a projection.
LITERAL = 4096


def degrees(edges: DataFrame) -> DataFrame:
    """(id, s): received edges of each node; one partial and one final count."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("s"))


def norm(scalars: DataFrame, p: float) -> DataFrame:
    return scalars.select("id", P.power(F.col("s"), p).alias("s"))


def row_scale(scalars: DataFrame, vectors: DataFrame) -> DataFrame:
    """s[v] * X[v, :]."""
    return vectors.join(scalars, "id").select("id", F.transform("vec", lambda x: x * F.col("s")).alias("vec"))


def slices(vectors: DataFrame, chunk: int) -> DataFrame:
    """(src, c, v, size): vectors in pieces of up to ``chunk`` values."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("vec") / chunk).cast("int") - 1, F.lit(0))), lambda c: F.struct(c.alias("c"), F.slice("vec", c * chunk + 1, F.lit(chunk)).alias("v")))
    return vectors.select(F.col("id").alias("src"), F.size("vec").alias("size"), F.explode(pieces).alias("p")).select("src", "size", "p.c", "p.v")


def assembled(pieces: DataFrame, names: list[str]) -> DataFrame:
    """(id, vec) of (id, c, size, a value for each of ``names``)."""
    whole = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", F.array(*names).alias("v")))).alias("t"), F.max("size").alias("size"))
    return whole.select("id", F.slice(F.flatten("t.v"), F.lit(1), F.col("size")).alias("vec"))


def aggregate(graph: Graph, vectors: DataFrame, fn: str = "sum", width: int | None = None, weights: DataFrame | None = None, chunk: int = WIDE, blocks: int | None = None) -> DataFrame:
    """For each receiver, ``fn`` (sum, mean or max) over its senders' vectors.

    An equi-join on the sender (a sender of very many edges can be split) and a
    group-by on the receiver, combined before the shuffle.  Edge weights multiply the vectors (max ignores them); on an
    unweighted graph the column is never read.  Up to ``chunk`` values a vector is
    one row with a sum for each value; wider ones are folded by chunks over a grid of
    node ``blocks``, whose tasks hold one chunk of a block.  Vectors of unknown width are
    cut into chunks before the join, and an edge is a row for each chunk.
    """
    edges = graph.edges if weights is None else weights
    weighted = (weights is not None or graph.weighted) and fn != "max"
    edges = edges.select("dst", "src", "w") if weighted else edges.select("dst", "src")
    f = {"sum": F.sum, "mean": F.avg, "max": F.max}[fn]
    value = (lambda x: F.col("w") * x) if weighted else (lambda x: x)
    if width is not None and width <= chunk:
        joined = dealt_join(edges, vectors.select(F.col("id").alias("src"), "vec"), "src")
        out = joined.groupBy(F.col("dst").alias("id")).agg(*(f(value(F.col("vec")[j])).alias(f"v{j}") for j in range(width)))
        return out.select("id", F.array(*(F.col(f"v{j}") for j in range(width))).alias("vec"))
    names = [f"v{j}" for j in range(chunk)]
    if width is not None:
        return assembled(grid.chunked(edges, vectors, fn, width, chunk, blocks), names)
    pieces = dealt_join(edges, slices(vectors, chunk), "src").groupBy(F.col("dst").alias("id"), "c")
    return assembled(pieces.agg(F.max("size").alias("size"), *(f(value(F.get("v", F.lit(j)))).alias(names[j]) for j in range(chunk))), names)


def matrix(w: Sequence[Sequence[float]]):
    """A literal array of the matrix's columns."""
    return F.array(*(F.array(*(F.lit(float(row[j])) for row in w)) for j in range(len(w[0]))))


def _product(vectors: DataFrame, w: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(w)
    schema = T.StructType([vectors.schema["id"], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches):
        w = shared.value
        for batch in batches:
            ids, vec = batch.columns
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), len(w))
            places = np.arange(len(vec) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(places), pa.array((x @ w).ravel()))], names=["id", "vec"])

    return vectors.mapInArrow(run, schema)


def ffn(vectors: DataFrame, w: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> DataFrame:
    """X W (+ b), one row in and one row out, without a shuffle: a projection
    while W is small, else a matrix product of each Arrow batch with W, which is
    broadcast and of the model's size."""
    rows, cols = len(w), len(w[0])
    if rows * cols <= LITERAL:
        out = vectors.select("id", F.transform(matrix(w), lambda c: P.dot(F.col("vec"), c)).alias("vec"))
    else:
        out = _product(vectors.select("id", "vec"), np.array(w, np.float64))
    if bias is not None:
        b = F.array(*(F.lit(float(x)) for x in bias))
        out = out.select("id", P.add(F.col("vec"), b).alias("vec"))
    return out


def project_to_scalar(vectors: DataFrame, a: Sequence[float]) -> DataFrame:
    """(id, s): the dot product of every vector with ``a``."""
    return vectors.select("id", P.dot(F.col("vec"), F.array(*(F.lit(float(x)) for x in a))).alias("s"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elementwise; nodes must be in both."""
    return a.join(b.select("id", F.col("vec").alias("other")), "id").select("id", P.add(F.col("vec"), F.col("other")).alias("vec"))


def pointwise(vectors: DataFrame, f) -> DataFrame:
    return vectors.select("id", P.on(F.col("vec"), f).alias("vec"))


def log_softmax(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", P.log_softmax(F.col("vec")).alias("vec"))


def constant(nodes: DataFrame, value: float = 1.0) -> DataFrame:
    """(id, s) with one value for all nodes."""
    return nodes.select("id", F.lit(float(value)).alias("s"))


def total(vectors: DataFrame) -> DataFrame:
    """(total): the sum of all values."""
    return vectors.select(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("x")).agg(F.sum("x").alias("total"))
