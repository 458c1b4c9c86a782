"""Receptive fields, induced subgraphs and dataset samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.graph import Graph

from .reorder import BLOCK, permute, permute_nodes


def receptive_field(edges: DataFrame, nodes: DataFrame, hops: int) -> list[DataFrame]:
    """For each hop, from the output inwards, the edges whose receivers are needed.

    Hop 1 has the edges into ``nodes``; each further hop those into the senders
    of the one before (and its receivers)."""
    found, wanted = [], nodes.select(F.col("id").alias("dst")).distinct()
    for _ in range(hops):
        own = edges.join(wanted, "dst", "left_semi")
        found.append(own)
        wanted = wanted.unionByName(own.select(F.col("src").alias("dst"))).distinct()
    return found


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").join(ids.select(F.col("id").alias("src")), "src", "left_semi")


def row_range(edges: DataFrame, low: int, high: int) -> DataFrame:
    """Edges of receivers low <= dst < high."""
    return edges.where((F.col("dst") >= low) & (F.col("dst") < high))


def percent_of_nodes(masks: DataFrame, percent: float) -> DataFrame:
    """(id): of each of train, valid and test the first ``percent`` of its nodes,
    and the last ``percent`` of all others.  Blocks of near ids are counted first;
    places are numbered by ``id`` within a block and follow on from its start."""
    kind = F.when(F.col("train"), 0).when(F.col("valid"), 1).when(F.col("test"), 2).otherwise(3)
    typed = masks.select("id", kind.alias("kind"))
    sizes = typed.groupBy("kind").agg(F.floor(F.count("*") * percent / 100).alias("n"), F.count("*").alias("total"))
    placed = typed.withColumn("block", F.floor(F.col("id") / BLOCK))
    blocks = placed.groupBy("kind", "block").agg(F.count("*").alias("size"))
    order = Window.partitionBy("kind").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    start = blocks.select("kind", "block", (F.sum("size").over(order) - F.col("size")).alias("start"))
    own = F.row_number().over(Window.partitionBy("kind", "block").orderBy("id"))
    ranked = placed.withColumn("own", own).join(start, ["kind", "block"]).withColumn("place", F.col("start") + F.col("own")).join(F.broadcast(sizes), "kind")
    return ranked.where(F.when(F.col("kind") < 3, F.col("place") <= F.col("n")).otherwise(F.col("place") > F.col("total") - F.col("n"))).select("id")


def _ranked(rows: DataFrame, block, order: list[str]) -> DataFrame:
    """rows with ``rank``, from 0, in an order that the blocks never cross: counts
    of blocks are put in one order, rows only within their block."""
    placed = rows.withColumn("block", block)
    sizes = placed.groupBy("block").agg(F.count("*").alias("size"))
    upto = F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    start = sizes.select("block", (upto - F.col("size")).alias("start"))
    own = F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1
    return placed.withColumn("own", own).join(start, "block").withColumn("rank", F.col("start") + F.col("own")).drop("block", "own", "start")


def dense_numbers(nodes: DataFrame) -> DataFrame:
    """perm(old, new): the nodes numbered 0, 1, 2, ... in order of their ids."""
    ranked = _ranked(nodes.select("id").distinct(), F.floor(F.col("id") / BLOCK), ["id"])
    return ranked.select(F.col("id").alias("old"), F.col("rank").cast("long").alias("new"))


def exact_masks(nodes: DataFrame, seed: int = 0, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Masks of exactly floor(train n) and floor(valid n) nodes, the rest test: a
    random permutation of the nodes, by a hash of the node and the seed, cut in
    three."""
    ids = nodes.select("id").distinct().withColumn("h", F.xxhash64("id", F.lit(seed)))
    ranked = _ranked(ids, F.shiftright("h", 48), ["h", "id"])
    total = ids.agg(F.count("*").alias("n"))
    # one row
    both = ranked.join(F.broadcast(total), F.lit(True))
    first = F.floor(F.col("n") * F.lit(train))
    second = first + F.floor(F.col("n") * F.lit(valid))
    return both.select("id", (F.col("rank") < first).alias("train"), ((F.col("rank") >= first) & (F.col("rank") < second)).alias("valid"), (F.col("rank") >= second).alias("test"))


def renumbered(graph: Graph, nodes: DataFrame, *data: DataFrame) -> tuple[Graph, DataFrame, list[DataFrame]]:
    """The subgraph that ``nodes`` induce and the data of these nodes, all under
    new numbers without gaps, with perm(old, new)."""
    perm = dense_numbers(nodes)
    # a name that perm lacks drops out, so renaming both ends induces the subgraph
    return graph.with_edges(permute(graph.edges, perm)), perm, [permute_nodes(d, perm) for d in data]


def sampled_dataset(graph: Graph, features: DataFrame, labels: DataFrame, masks: DataFrame, percent: float) -> tuple[Graph, DataFrame, DataFrame, DataFrame]:
    """A dataset of ``percent_of_nodes``, renumbered."""
    own, _, (x, y, m) = renumbered(graph, percent_of_nodes(masks, percent), features, labels, masks)
    return own, x, y, m
