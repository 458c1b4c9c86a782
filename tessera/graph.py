"""Graphs and node data as DataFrames.

edges     (dst LONG, src LONG[, w DOUBLE]): ``dst`` receives from ``src``
vectors   (id LONG, vec ARRAY<DOUBLE>): one row a node
scalars   (id LONG, s DOUBLE)
long form (id LONG, j INT, v DOUBLE): what queries return
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Edges with what the planner may assume of them."""

    edges: DataFrame
    undirected: bool = False
    unweighted: bool = True
    sparse: bool = True

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    @property
    def weighted(self) -> bool:
        return not self.unweighted and "w" in self.edges.columns


def undirected(edges: DataFrame) -> DataFrame:
    """The edges and their reverses, once each."""
    pairs = edges.select("dst", "src")
    return pairs.unionByName(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    """Every edge reversed, weights kept."""
    rest = [c for c in edges.columns if c not in ("dst", "src")]
    return edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), *rest)


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exactly one loop at every node, as exporters of datasets leave them."""
    loops = nodes.select(F.col("id").alias("dst"), F.col("id").alias("src")).distinct()
    return edges.where("dst <> src").select("dst", "src").unionByName(loops)


def to_long(vectors: DataFrame, digits: int | None = 6, value: str = "v") -> DataFrame:
    """(id, j, v), rounded."""
    out = vectors.select("id", F.posexplode("vec").alias("j", "x"))
    x = F.col("x") if digits is None else F.round("x", digits)
    return out.select("id", "j", (x + F.lit(0.0)).alias(value))


def to_vectors(long: DataFrame, value: str = "v") -> DataFrame:
    """The inverse of ``to_long``."""
    pairs = F.array_sort(F.collect_list(F.struct("j", F.col(value).alias("x"))))
    return long.groupBy("id").agg(F.transform(pairs, lambda p: p.x).alias("vec"))
