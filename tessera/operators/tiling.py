"""Tiles of a graph: by sender column, by receiver row, by number of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.skew import dealt_join

from .adjacency import offsets as offsets
from .adjacency import running_edges
from .nodes import assembled, slices
from .reorder import BLOCK


def column_tiles(edges: DataFrame, size: int) -> DataFrame:
    """edges with ``tile``; receivers without edges in a tile have no row there."""
    return edges.withColumn("tile", F.floor(F.col("src") / size).cast("long"))


def tile_bounds(edges: DataFrame, size: int) -> DataFrame:
    """(tile, dst, begin, end): places of each tile's rows in the tile's order."""
    counts = column_tiles(edges, size).groupBy("tile", "dst").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("dst") / BLOCK))
    blocks = counts.groupBy("tile", "block").agg(F.sum("n").alias("size"))
    upto = lambda c, by, order: F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    start = blocks.select("tile", "block", (upto("size", ["tile"], "block") - F.col("size")).alias("start"))
    end = F.col("start") + F.col("own")
    own = counts.withColumn("own", upto("n", ["tile", "block"], "dst"))
    return own.join(start, ["tile", "block"]).select("tile", "dst", (end - F.col("n")).alias("begin"), end.alias("end"))


def tiled_aggregate(edges: DataFrame, vectors: DataFrame, size: int, width: int | None = None, fn: str = "sum", wide: int = 64) -> DataFrame:
    """``fn`` (sum, mean or max) by tiles: a partial value for each (tile,
    receiver), then one for each receiver.  A column ``w`` of the edges multiplies
    the vectors (max ignores it).  Up to ``wide`` values are columns of one
    group-by, wider vectors (or ones of unknown width) are cut into chunks of it."""
    weighted = "w" in edges.columns and fn != "max"
    tiles = column_tiles(edges.select("dst", "src", *(["w"] if weighted else [])), size)
    value = (lambda x: F.col("w") * x) if weighted else (lambda x: x)
    fold, seen = (F.max if fn == "max" else F.sum), F.count("*").alias("seen")
    whole = (lambda c: F.sum(c) / F.sum("seen")) if fn == "mean" else fold
    if width is not None and width <= wide:
        joined = dealt_join(tiles, vectors.select(F.col("id").alias("src"), "vec"), "src")
        partial = joined.groupBy("tile", "dst").agg(seen, *(fold(value(F.col("vec")[j])).alias(f"v{j}") for j in range(width)))
        final = partial.groupBy(F.col("dst").alias("id")).agg(*(whole(f"v{j}").alias(f"v{j}") for j in range(width)))
        return final.select("id", F.array(*(F.col(f"v{j}") for j in range(width))).alias("vec"))
    names, size = [f"v{j}" for j in range(wide)], F.max("size").alias("size")
    pieces = dealt_join(tiles, slices(vectors, wide), "src").groupBy("tile", "dst", "c")
    partial = pieces.agg(seen, size, *(fold(value(F.get("v", F.lit(j)))).alias(names[j]) for j in range(wide)))
    return assembled(partial.groupBy(F.col("dst").alias("id"), "c").agg(size, *(whole(v).alias(v) for v in names)), names)


def work_mask(edges: DataFrame, size: int) -> DataFrame:
    """(tile, dst, first, last, next_tile): which of a receiver's tiles comes
    first and last, hence which one should fire the dense update."""
    tiles = column_tiles(edges, size).select("tile", "dst").distinct()
    w = Window.partitionBy("dst").orderBy("tile")
    return tiles.select("tile", "dst", F.lag("tile").over(w).isNull().alias("first"), F.lead("tile").over(w).isNull().alias("last"), F.lead("tile").over(w).alias("next_tile"))


def row_tiles(edges: DataFrame, rows: int) -> DataFrame:
    """(tile, rows, n): receivers in tiles of a fixed number of rows."""
    return edges.groupBy(F.floor(F.col("dst") / rows).cast("long").alias("tile")).agg(F.countDistinct("dst").alias("rows"), F.count("*").alias("n"))


def equal_edge_tiles(edges: DataFrame, per_tile: int) -> DataFrame:
    """(tile, low, high, n): runs of receivers with about ``per_tile`` edges."""
    placed = running_edges(edges).withColumn("tile", F.floor(F.col("before") / per_tile).cast("long"))
    return placed.groupBy("tile").agg(F.min("dst").alias("low"), F.max("dst").alias("high"), F.sum("n").alias("n"))


def tiles_by_size(edges: DataFrame, rows: int) -> DataFrame:
    """``row_tiles``, the largest first: (place, tile, n).  Places come from counts
    of blocks of equal size and near numbers, as in ``reorder.by_degree``."""
    tiles = row_tiles(edges, rows).withColumn("block", F.floor(F.col("tile") / BLOCK))
    levels = tiles.groupBy("n", "block").agg(F.count("*").alias("size"))
    order = Window.orderBy(F.desc("n"), "block").rowsBetween(Window.unboundedPreceding, 0)
    start = levels.select("n", "block", (F.sum("size").over(order) - F.col("size")).alias("start"))
    own = F.row_number().over(Window.partitionBy("n", "block").orderBy("tile")) - 1
    return tiles.join(start, ["n", "block"]).select((F.col("start") + own).cast("long").alias("place"), "tile", "n")


def padded(edges: DataFrame, rows: int, multiple: int) -> DataFrame:
    """(tile, n, padding): entries of zero that fill each row tile to a multiple."""
    return row_tiles(edges, rows).select("tile", "n", F.pmod(-F.col("n"), F.lit(multiple)).alias("padding"))


def padded_edges(edges: DataFrame, rows: int, multiple: int) -> DataFrame:
    """(dst, src, w, padding): the edges of each row tile, filled to a multiple by
    repeats of its last edge with weight 0, which change no sum."""
    value = F.col("w") if "w" in edges.columns else F.lit(1.0)
    own = edges.select("dst", "src", value.cast("double").alias("w"), F.lit(False).alias("padding"))
    last = edges.groupBy(F.floor(F.col("dst") / rows).cast("long").alias("tile")).agg(F.max(F.struct("dst", "src")).alias("e"), F.count("*").alias("n"))
    lack = F.pmod(-F.col("n"), F.lit(multiple)).cast("int")
    extra = last.select("e", F.explode(F.array_repeat(F.lit(0.0), lack)).alias("w"))
    return own.unionByName(extra.select("e.dst", "e.src", "w", F.lit(True).alias("padding")))


def dense_slice(vectors: DataFrame, begin: int, width: int) -> DataFrame:
    """Columns begin .. begin + width - 1 of every vector."""
    return vectors.select("id", F.slice("vec", begin + 1, width).alias("vec"))
