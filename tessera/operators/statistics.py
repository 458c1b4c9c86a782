"""Statistics of graphs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import adjacency
from .nodes import degrees


def graph_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, e, max_degree, density): what schedules are chosen by."""
    deg = degrees(edges).agg(F.sum("s").cast("long").alias("e"), F.max("s").cast("long").alias("max_degree"))
    n = nodes.agg(F.count("*").alias("n"))
    # two single rows
    return n.join(deg, F.lit(True)).select("n", "e", "max_degree", (F.col("e") / (F.col("n") * F.col("n"))).alias("density"))


def degree_statistics(edges: DataFrame) -> DataFrame:
    """Least, greatest and mean degree, deviation, entropy, and entropy over its bound."""
    d = degrees(edges)
    totals = d.agg(F.sum("s").alias("e"), F.count("*").alias("n"))
    p = F.col("s") / F.col("e")
    return d.join(F.broadcast(totals), F.lit(True)).agg(
        F.min("s").cast("long").alias("min_degree"), F.max("s").cast("long").alias("max_degree"), F.avg("s").alias("mean_degree"), F.stddev_pop("s").alias("std_degree"),
        F.sum(-p * F.log(p)).alias("entropy"), (F.sum(-p * F.log(p)) / F.log(F.max("n"))).alias("norm_entropy"),
    )


def degree_histogram_entropy(edges: DataFrame, percent: float, n_nodes: int) -> DataFrame:
    """(entropy) of the degree histogram of the first ``percent`` of all rows."""
    first = degrees(edges).where(F.col("id") < int(n_nodes * percent / 100))
    hist = first.groupBy("s").agg(F.count("*").alias("c"))
    total = hist.agg(F.sum("c").alias("t"))
    p = F.col("c") / F.col("t")
    return hist.join(F.broadcast(total), F.lit(True)).agg(F.sum(-p * F.log(p)).alias("entropy"))


def locality(edges: DataFrame) -> DataFrame:
    """(distance, gap): roots of the mean distance of an edge's ends, and of the
    mean gap between neighbours that follow each other.  A receiver's gaps add up
    to its greatest sender less its smallest, so no order is made."""
    per = edges.groupBy("dst").agg(F.sum(F.abs(F.col("dst") - F.col("src"))).alias("d"), (F.max("src") - F.min("src")).alias("g"), F.count("*").alias("n"))
    gaps = F.sum(F.col("n") - 1)
    return per.agg(F.sqrt(F.sum("d") / F.sum("n")).alias("distance"), F.sqrt(F.when(gaps > 0, F.sum("g") / gaps)).alias("gap"))


def spread(values: DataFrame, column: str) -> DataFrame:
    """(mean, variance, std) of a sample."""
    return values.agg(F.avg(column).alias("mean"), F.var_samp(column).alias("variance"), F.stddev_samp(column).alias("std"))


def distribution(edges: DataFrame) -> DataFrame:
    """Quartiles, range, Gini coefficient and share of the top tenth of the
    degrees.  Degrees are counted by value first: as many rows as distinct degrees."""
    hist = degrees(edges).groupBy(F.col("s").cast("long").alias("d")).agg(F.count("*").alias("c"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.select("d", "c", F.sum("c").over(w).alias("upto"))
    totals = hist.agg(F.sum("c").alias("n"), F.sum(F.col("d") * F.col("c")).alias("e"))
    both = run.join(F.broadcast(totals), F.lit(True))
    # the i-th of n sorted values weighs 2 i - n - 1
    weight = F.col("c") * (2 * F.col("upto") - F.col("c") + 1 - F.col("n") - 1)
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("d")))
    top = F.col("d") * F.greatest(F.lit(0), F.least(F.col("c"), F.col("upto") - F.floor(F.col("n") * 0.9)))
    return both.agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), (F.max("d") - F.min("d")).alias("spread"), (F.sum(weight * F.col("d")) / (F.max("n") * F.max("e"))).alias("gini"), (F.sum(top) / F.max("e")).alias("top_share"))


#: What entries are counted by, and the grouping's number (a bit for each of row,
#: column, row block and column block that it leaves out).
COUNTED = {"row": 0b0111, "column": 0b1011, "row_block": 0b1101, "column_block": 0b1110, "tile": 0b1100}


def _described(hist: DataFrame, suffix: str) -> DataFrame:
    """Statistics of each grouping's values from their histogram (g, v, c): a row
    for each distinct count, so the windows are short."""
    every, rising = Window.partitionBy("g"), Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    falling = Window.partitionBy("g").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    h = hist.select("g", "v", "c", F.sum("c").over(every).alias("n"), F.sum(F.col("v") * F.col("c")).over(every).alias("t"), F.sum("c").over(rising).alias("upto"), F.coalesce(F.sum("c").over(falling), F.lit(0)).alias("above"), F.coalesce(F.sum(F.col("v") * F.col("c")).over(falling), F.lit(0)).alias("sum_above"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))  # noqa: E731 (the place-th value, from 0)
    mean = F.max("t") / F.max("n")
    variance = F.sum(F.col("c") * (F.col("v") - F.col("t") / F.col("n")) * (F.col("v") - F.col("t") / F.col("n"))) / F.max("n")
    # the i-th of n sorted values weighs 2 i - n - 1
    gini = F.sum(F.col("c") * (2 * F.col("upto") - F.col("c") - F.col("n")) * F.col("v")) / (F.max("n") * F.max("t"))
    # of the largest values the fewest that hold as great a share as they leave out elements
    more = F.ceil((F.col("t") * (F.col("n") - F.col("above")) - F.col("sum_above") * F.col("n")) / (F.col("v") * F.col("n") + F.col("t")))
    pratio = F.min(F.when(more <= F.col("c"), F.col("above") + F.greatest(more, F.lit(1)))) / F.max("n")
    out = {"min": F.min("v"), "max": F.max("v"), "mean": mean, "median": (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2, "variance": variance, "stddev": F.sqrt(variance), "gini": gini, "pratio": pratio}
    return h.groupBy("g").agg(*(x.cast("double").alias(f"{k}{suffix}") for k, x in out.items()))


def distributions(edges: DataFrame, n_rows: int, n_cols: int, block_rows: int, block_cols: int) -> DataFrame:
    """One row for rows, columns, row blocks, column blocks and tiles of a matrix:
    statistics of their numbers of edges, over all of them and (``_nz``) over
    those with any.

    One pass counts edges for all groupings, one more counts equal counts;
    everything follows from these histograms.
    """
    keyed = edges.select(F.col("dst").alias("r"), F.col("src").alias("k"), F.floor(F.col("dst") / block_rows).alias("rb"), F.floor(F.col("src") / block_cols).alias("cb"))
    r, k, rb, cb = (F.col(x) for x in ("r", "k", "rb", "cb"))
    counts = keyed.groupingSets([[r], [k], [rb], [cb], [rb, cb]], r, k, rb, cb).agg(F.count("*").alias("v"), F.grouping_id().alias("g"))
    some = counts.groupBy("g", "v").agg(F.count("*").alias("c"))
    rows_of, cols_of = -(-n_rows // block_rows), -(-n_cols // block_cols)
    sizes = dict(zip(COUNTED.values(), (n_rows, n_cols, rows_of, cols_of, rows_of * cols_of), strict=True))
    size = F.coalesce(*(F.when(F.col("g") == g, F.lit(n)) for g, n in sizes.items())).cast("long")
    totals = some.groupBy("g").agg(F.sum("c").alias("nonzero"), F.sum(F.col("v") * F.col("c")).cast("double").alias("sum")).withColumn("nelems", size)
    none = totals.where(F.col("nelems") > F.col("nonzero")).select("g", F.lit(0).cast("long").alias("v"), (F.col("nelems") - F.col("nonzero")).alias("c"))
    name = F.coalesce(*(F.when(F.col("g") == g, F.lit(k)) for k, g in COUNTED.items()))
    out = totals.join(_described(some.unionByName(none), ""), "g").join(_described(some, "_nz"), "g")
    return out.withColumn("nonzero_ratio", F.col("nonzero") / F.col("nelems")).select(name.alias("counted"), *(c for c in out.columns if c != "g"), "nonzero_ratio")


def locality_ratios(edges: DataFrame, sizes: tuple[int, ...] = (1, 4, 8, 16, 32, 64), chunk: int = adjacency.CHUNK) -> DataFrame:
    """For each block size the share of a receiver's edges that begin a new block of senders."""
    found = adjacency.block_changes(adjacency.rows(edges.select("dst", "src"), chunk=chunk), sizes)
    return found.select(*((F.col(f"c{s}") / F.col("e")).alias(f"ratio_{s}") for s in sizes))


# losses and predictions


def cross_entropy(logits: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """(loss): mean of log(sum(exp(x))) - x[label] over the rows named."""
    some = logits.join(rows.select("id"), "id", "left_semi").join(labels, "id")
    lse = F.log(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.exp(x)))
    return some.agg(F.avg(lse - F.element_at("vec", F.col("label") + 1)).alias("loss"))


def argmax(vectors: DataFrame) -> DataFrame:
    """(id, pred): the place of each vector's largest value, the first of equals."""
    return vectors.select("id", (F.array_position("vec", F.array_max("vec")) - 1).cast("int").alias("pred"))


def accuracy(logits: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """(accuracy): percent of the rows whose largest logit is the label's."""
    both = argmax(logits).join(labels, "id").join(rows.select("id"), "id", "left_semi")
    return both.agg((100.0 * F.avg((F.col("pred") == F.col("label")).cast("double"))).alias("accuracy"))
