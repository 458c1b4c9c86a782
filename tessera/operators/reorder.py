"""Permutations and orders of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.graph import transpose

from . import adjacency

#: Nodes whose numbers are this near are numbered together.
BLOCK = 1 << 16


def permute(edges: DataFrame, perm: DataFrame, rows: bool = True, columns: bool = True) -> DataFrame:
    """Edges with ends renamed by perm(old, new)."""
    rest = [c for c in edges.columns if c not in ("dst", "src")]
    if rows:
        edges = edges.join(perm.select(F.col("old").alias("dst"), "new"), "dst").select(F.col("new").alias("dst"), "src", *rest)
    if columns:
        edges = edges.join(perm.select(F.col("old").alias("src"), "new"), "src").select("dst", F.col("new").alias("src"), *rest)
    return edges


def permute_nodes(data: DataFrame, perm: DataFrame, inverse: bool = False) -> DataFrame:
    """Node data renamed by perm(old, new), or back."""
    old, new = ("new", "old") if inverse else ("old", "new")
    rest = [c for c in data.columns if c != "id"]
    return data.join(perm.select(F.col(old).alias("id"), F.col(new).alias("to")), "id").select(F.col("to").alias("id"), *rest)


def identity(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("old"), F.col("id").alias("new"))


def reversed_order(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.select(F.col("id").alias("old"), (F.lit(n - 1) - F.col("id")).alias("new"))


def listed_first(edges: DataFrame, listed: DataFrame, chunk: int = adjacency.CHUNK) -> DataFrame:
    """(dst, src, place): each receiver's edges, senders of listed(id, rank) first."""
    ranked = edges.select("dst", "src").join(listed.select(F.col("id").alias("src"), F.col("rank").cast("long").alias("rank")), "src", "left")
    # listed senders by blocks of ranks, the others behind them by blocks of numbers
    block = F.when(F.col("rank").isNull(), F.lit(1 << 62) + adjacency.sender_block()).otherwise(F.floor(F.col("rank") / adjacency.BLOCK)).cast("long")
    packed = adjacency.rows(ranked, [F.col("rank").isNull(), F.col("rank")], block, chunk)
    return adjacency.edges_of(packed).select("dst", "src", "place")


def by_degree(edges: DataFrame) -> DataFrame:
    """perm(old, new): senders numbered by frequency, the most frequent first;
    equals by their number.  Ranks come from counts of blocks of equal frequency
    and near numbers, so that only one row for each block is put in one order."""
    freq = edges.groupBy(F.col("src").alias("old")).agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("old") / BLOCK))
    levels = freq.groupBy("n", "block").agg(F.count("*").alias("size"))
    order = Window.orderBy(F.desc("n"), "block").rowsBetween(Window.unboundedPreceding, 0)
    start = levels.select("n", "block", (F.sum("size").over(order) - F.col("size")).alias("start"))
    return freq.join(start, ["n", "block"]).select("old", (F.col("start") + F.row_number().over(Window.partitionBy("n", "block").orderBy("old")) - 1).alias("new"))


def dense_columns(edges: DataFrame, threshold: int) -> DataFrame:
    """(id, n): senders of more than ``threshold`` edges."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > threshold)


def boundary_rows(edges: DataFrame, mark: int = -1) -> DataFrame:
    """(dst): receivers whose last stored sender is ``mark``, as padded rows have it."""
    return edges.groupBy("dst").agg(F.max_by("src", F.struct(F.col("src") == mark, F.col("src"))).alias("last")).where(F.col("last") == mark).select("dst")


def row_order(edges: DataFrame) -> DataFrame:
    """Edges by receiver, then sender, with their ``place``."""
    return adjacency.ordered(edges)


def column_order(edges: DataFrame) -> DataFrame:
    """Edges by sender, then receiver, with their ``place``."""
    return transpose(adjacency.ordered(transpose(edges)))


def same_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): edges that one multiset has and the other lacks, counted.
    One group-by of signed counts: no side is sorted, and a task holds each pair once."""
    signed = a.select("dst", "src", F.lit(1).cast("long").alias("d")).unionByName(b.select("dst", "src", F.lit(-1).cast("long").alias("d")))
    more = signed.groupBy("dst", "src").agg(F.sum("d").alias("d"))
    return more.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_b"))


#: Shifts and masks that spread the bits of a 32-bit number to every second bit.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(x):
    x = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(row, column):
    """The Z-order code of two 32-bit columns: the row's bits in the odd places,
    the column's in the even ones.  Rows from 2**31 on make it negative: compare
    it as unsigned, or by ``morton_key``."""
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(column))


def morton_key(row, column):
    """``morton`` with its top bit turned, so that signed order is Z-order."""
    return morton(row, column).bitwiseXOR(F.lit(-(1 << 63)))


def morton_layout(edges: DataFrame, parts: int) -> DataFrame:
    """Edges in ranges of their Z-order, sorted within: each of ``parts`` files
    written from it covers few, near ranges of receivers and senders, so that the
    reader's own statistics skip the files of other tiles."""
    key = morton_key(F.col("dst"), F.col("src"))
    return edges.withColumn("code", key).repartitionByRange(parts, "code").sortWithinPartitions("code").drop("code")
