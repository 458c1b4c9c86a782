"""Generated graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rmat(spark: SparkSession, scale: int, n_edges: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 27491095, mirrored: bool = False) -> DataFrame:
    """A recursive-matrix graph over 2^scale nodes: each edge descends ``scale``
    times into a quadrant.  Draws are hashes of (edge, level, seed), so that a
    task that runs again makes the same edges; repeats are dropped."""
    dst, src = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(scale):
        u = F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        right = ((u >= a) & (u < a + b)) | (u >= a + b + c)
        down = u >= a + b
        dst, src = dst * 2 + down.cast("long"), src * 2 + right.cast("long")
    edges = spark.range(n_edges).select(dst.alias("dst"), src.alias("src"))
    if mirrored:
        edges = edges.unionByName(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")))
    return edges.distinct()


def radius_edges(points: DataFrame, radius: float) -> DataFrame:
    """(dst, src) of all pairs of points(id, x, y) closer than ``radius``.

    A range join by a grid with cells of one radius: a point meets the nine
    cells around it by an equi-join, and distances decide."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    own = points.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = points.select(F.col("id").alias("dst"), "x", "y", F.explode(F.transform(near, lambda d: cell("x") + d)).alias("cx"))
    around = around.select("dst", "x", "y", "cx", F.explode(F.transform(near, lambda d: cell("y") + d)).alias("cy"))
    met = around.join(own, ["cx", "cy"])
    square = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
    return met.where((F.col("dst") != F.col("src")) & (square < radius * radius)).select("dst", "src")
