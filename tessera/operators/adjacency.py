"""Adjacency rows of bounded size.

A row (dst, chunk, first, deg, senders[, ws]) holds a run of a receiver's edges
in a given order, from place ``first`` on; ``deg`` is the receiver's number of
edges.  A receiver of up to ``chunk`` edges is one row.  A larger one, a hub, is
several, which any tasks may hold: its edges are counted by blocks of the order
(neighbouring senders, say), the blocks' starts are sums of these counts, and a
chunk is the blocks that start within the same ``chunk`` places.  So no window
and no group ever holds a hub's edges, only one count for each of its blocks,
and a row has at most ``chunk`` edges and one block more.

Places then are row-local: a sample by places is a lookup in arrays, and only
the last sender of a chunk has to be carried to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.skew import spread

#: Edges in a row, about.
CHUNK = 1 << 14
#: Senders, by their numbers, that are counted together.
BLOCK = 1 << 14


def sender_block(size: int = BLOCK) -> Column:
    return F.floor(F.col("src") / size).cast("long")


def hub_chunks(edges: DataFrame, chunk: int) -> DataFrame:
    """(dst, block, chunk, start, deg) of receivers of more than ``chunk`` edges,
    from edges with ``block``."""
    tallies = edges.groupBy("dst", "block").agg(F.count("*").alias("n"))
    tables = tallies.groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("t"), F.sum("n").alias("deg")).where(F.col("deg") > chunk).drop("deg")

    def run(batches):
        for batch in batches:
            table = batch.column("t")
            sizes = np.diff(table.offsets.to_numpy())
            blocks, n = table.flatten().flatten()
            n = n.to_numpy()
            ends = np.cumsum(n)
            last = np.cumsum(sizes)
            total = np.diff(np.concatenate(([0], ends[last - 1] if len(last) else [])))
            start = ends - n - np.repeat(np.cumsum(total) - total, sizes)
            columns = [np.repeat(batch.column("dst").to_numpy(), sizes), blocks, start // chunk, start, np.repeat(total, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["dst", "block", "chunk", "start", "deg"])

    return tables.mapInArrow(run, "dst long, block long, chunk long, start long, deg long")


def rows(edges: DataFrame, order: list[Column] | None = None, block: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """The adjacency rows of ``edges``, in order of their senders, or of the
    columns ``order``; ``block`` (LONG) must never fall along that order."""
    weighted = "w" in edges.columns
    fields = [*(c.alias(f"o{i}") for i, c in enumerate(order or [])), F.col("src").alias("src"), *([F.col("w").alias("w")] if weighted else [])]
    own = spread(edges.select("dst", F.struct(*fields).alias("e"), (sender_block() if block is None else block).alias("block")), edges, "dst", "block")
    dealt = own.join(hub_chunks(own, chunk), ["dst", "block"], "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)).cast("long"))
    packed = spread(dealt, edges, "dst", "chunk").groupBy("dst", "chunk").agg(F.sort_array(F.collect_list("e")).alias("e"), F.min("start").alias("start"), F.max("deg").alias("deg"))
    arrays = [F.col("e.src").alias("senders"), *([F.col("e.w").alias("ws")] if weighted else [])]
    return packed.select("dst", "chunk", F.coalesce("start", F.lit(0)).cast("long").alias("first"), F.coalesce("deg", F.size("e")).cast("long").alias("deg"), *arrays)


def edges_of(packed: DataFrame) -> DataFrame:
    """(dst, src[, w], place, deg): rows back as edges, with each edge's place."""
    if "ws" in packed.columns:
        each = packed.select("dst", "first", "deg", F.posexplode(F.arrays_zip("senders", "ws")).alias("at", "e")).select("dst", "first", "deg", "at", F.col("e.senders").alias("src"), F.col("e.ws").alias("w"))
    else:
        each = packed.select("dst", "first", "deg", F.posexplode("senders").alias("at", "src"))
    return each.select("dst", "src", *(["w"] if "w" in each.columns else []), (F.col("first") + F.col("at")).alias("place"), "deg")


def picked(packed: DataFrame, n: int, place) -> DataFrame:
    """(dst, src, i): for each i < n the edge at place(i) of every receiver, by
    lookup in the row that has it; ``place`` may read the column ``deg``."""
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), (place(i) - F.col("first")).cast("int").alias("at")))
    here = F.filter(wanted, lambda x: (x.at >= 0) & (x.at < F.size("senders")))
    return packed.select("dst", "senders", F.explode(here).alias("x")).select("dst", F.element_at("senders", F.col("x.at") + 1).alias("src"), F.col("x.i").alias("i"))


def block_changes(packed: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(e, c<size>...): edges, and how many of them begin a new block of ``size``
    senders within their receiver's order.  Rows count for themselves; of hubs
    the chunks' outer senders are compared."""

    def run(batches):
        for batch in batches:
            offsets = batch.column("senders").offsets.to_numpy().astype(np.int64)
            senders = batch.column("senders").flatten().to_numpy()
            starts = offsets[:-1] - offsets[0]
            out = []
            for s in sizes:
                block = senders // s
                new = np.ones(len(block), bool)
                new[1:] = block[1:] != block[:-1]
                new[starts] = True
                out.append(pa.array([int(new.sum())], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([len(senders)], pa.int64()), *out], names=["e", *(f"c{s}" for s in sizes)])

    inner = packed.select("senders").mapInArrow(run, "e long, " + ", ".join(f"c{s} long" for s in sizes))
    ends = packed.where(F.col("deg") > F.size("senders")).select("dst", "chunk", F.element_at("senders", 1).alias("a"), F.element_at("senders", -1).alias("b"))
    chains = ends.groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("chunk", "a", "b"))).alias("t")).select(F.explode(F.arrays_zip(F.slice("t.a", F.lit(2), F.size("t")), F.slice("t.b", F.lit(1), F.size("t") - 1))).alias("x"))
    same = [(-(F.floor(F.col("x")["0"] / s) == F.floor(F.col("x")["1"] / s)).cast("long")).alias(f"c{s}") for s in sizes]
    return inner.unionByName(chains.select(F.lit(0).cast("long").alias("e"), *same)).agg(F.sum("e").alias("e"), *(F.sum(f"c{s}").alias(f"c{s}") for s in sizes))


def running_edges(edges: DataFrame, block: int = 4096) -> DataFrame:
    """(dst, n, before): received edges of each node, and those of all smaller
    nodes.  Blocks of nodes are summed apart and only block sums are put in one
    order, so that no window holds all nodes."""
    counts = edges.groupBy("dst").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("dst") / block))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    start = blocks.select("block", (F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    own = F.sum("n").over(Window.partitionBy("block").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.withColumn("own", own).join(start, "block").select("dst", "n", (F.col("start") + F.col("own")).alias("before"))


def offsets(edges: DataFrame) -> DataFrame:
    """(dst, begin, end): each receiver's range in edges ordered by (dst, src)."""
    return running_edges(edges).select("dst", F.col("before").alias("begin"), (F.col("before") + F.col("n")).alias("end"))


def ordered(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """edges in order of (dst, src), with their place in it."""
    each = edges_of(rows(edges, chunk=chunk))
    begin = offsets(edges).select("dst", "begin")
    return each.join(begin, "dst").withColumn("place", F.col("begin") + F.col("place")).drop("begin", "deg").orderBy("place")
