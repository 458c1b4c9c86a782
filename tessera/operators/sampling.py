"""Neighbour sampling, by lookup in adjacency rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adjacency

#: Factors of the fixed sample: the i-th edge taken is number (5 i + 7) mod degree.
FACTOR, SHIFT = 5, 7


def affine(edges: DataFrame, n: int, factor: int = FACTOR, shift: int = SHIFT, chunk: int = adjacency.CHUNK) -> DataFrame:
    """Exactly ``n`` edges of every receiver, repeats allowed; receivers without
    edges have no row, so no degree is zero."""
    packed = adjacency.rows(edges.select("dst", "src"), chunk=chunk)
    return adjacency.picked(packed, n, lambda i: (i * factor + shift) % F.col("deg"))


def dynamic(edges: DataFrame, n: int, rng: np.random.Generator) -> DataFrame:
    """``affine`` with factors drawn anew, as integers in 0..100, for each forward pass."""
    factor, shift = rng.integers(0, 101, 2)
    return affine(edges, n, int(factor), int(shift))


def shuffled(edges: DataFrame, n: int, seed: int = 0, chunk: int = adjacency.CHUNK) -> DataFrame:
    """``n`` edges in a random order of each receiver's, wrapping around: every
    neighbour once before any repeats.  The order is a hash of the edge and the
    seed, so a task that runs again draws the same; a hub's blocks are ranges of
    that hash."""
    order = F.xxhash64("dst", "src", F.lit(seed))
    packed = adjacency.rows(edges.select("dst", "src"), [order], F.shiftright(order, 48), chunk)
    return adjacency.picked(packed, n, lambda i: i % F.col("deg"))
