"""Schedules chosen from a graph's statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.operators.statistics import graph_statistics

#: Above this density a graph is cut in column tiles.
DENSE = 0.001
#: Tiles of a dense graph.
TILES = 5


@dataclass(frozen=True)
class Plan:
    """Tile size (None: no tiles), whether to fuse scales, and shuffle partitions."""

    nodes: int
    edges: int
    density: float
    col_tile: int | None
    fuse: bool
    partitions: int


def choose(edges: DataFrame, nodes: DataFrame, edges_per_partition: int = 4_000_000) -> Plan:
    """One aggregate over the edges decides."""
    r = graph_statistics(edges, nodes).first()
    dense = (r.density or 0) > DENSE
    return Plan(r.n, r.e or 0, r.density or 0.0, max(1, r.n // TILES) if dense else None, not dense, max(1, -(-(r.e or 0) // edges_per_partition)))
