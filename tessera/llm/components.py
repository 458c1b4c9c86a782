"""Connected components by alternating star contraction, DataFrame operations only.

Each round hangs every node's larger neighbours, then its smaller ones, on the
node's smallest neighbour; O(log^2 n) rounds turn a component into one star.
A round aggregates (combined before the shuffle) and joins the minimum back to
the edges, so that a node of very high degree is a skewed join key, which
adaptive execution splits, and never a group held in one task.  Rounds end as
soon as all pairs are stars, and are written to the shared folder: lineage stays
short and lost executors cost a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.skew import dealt_join

from .shared import drop, written


def _hang(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest v of its u."""
    return dealt_join(pairs, pairs.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m")


def _stars(pairs: DataFrame) -> bool:
    """Whether distinct pairs u > v are stars: no u has two v or is one itself."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.id").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") == 0))).count() == 0


def connected_components(edges: DataFrame, u: str, v: str, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges``; component is the smallest id
    reachable.  Loops, repeats and either order of a pair change nothing; pairs
    with a null are left out; no edges give no rows."""
    now = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null and u <> v").select("u", "v").distinct(), name)
    for _ in range(max_rounds):
        if _stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        hung = _hang(large)
        small = hung.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, written(small, name)
        drop(before)
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    # now every u has its component's smallest node as v
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
