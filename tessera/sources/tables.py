"""The graph, features, labels and masks derived from the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.graph import Graph


#: Lines that one task makes distinct edges of.
LINES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_count(spark: SparkSession, sf_dir: str) -> int:
    """The number of nodes; a parquet footer's row count."""
    return table(spark, sf_dir, "embeddings").count()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> supplier line pairs folded onto the nodes, with one loop a node.

    Lines are dealt by their pair to a number of tasks that follows theirs (from the
    footers) and made distinct there: a map-side distinct holds a whole file split's
    pairs, and adaptive execution would put partitions together up to a size of
    compressed bytes, so that a task's memory would grow with the table."""
    n = F.lit(max(1, node_count(spark, sf_dir)))
    every = table(spark, sf_dir, "lineitem")
    parts = 1 + every.count() // LINES
    lines = every.select((F.col("l_partkey") % n).alias("dst"), ((F.col("l_suppkey") * 5 + F.col("l_linenumber")) % n).alias("src"))
    loops = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("dst"), F.col("vec_id").alias("src"))
    return lines.where("dst <> src").unionByName(loops).repartition(parts, "dst", "src").distinct()


def graph(spark: SparkSession, sf_dir: str, undirected: bool = False) -> Graph:
    from tessera.graph import undirected as mirrored

    own = edges(spark, sf_dir)
    return Graph(mirrored(own) if undirected else own, undirected=undirected)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec) of every node."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train 70 %, validation 10 % and test 20 % by the node's number."""
    r = F.col("id") % 10
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")).select("id", (r <= 6).alias("train"), (r == 7).alias("valid"), (r >= 8).alias("test"))


def load(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame, DataFrame, DataFrame]:
    """Graph, features, labels and masks of a dataset."""
    return graph(spark, sf_dir), features(spark, sf_dir), labels(spark, sf_dir), masks(spark, sf_dir)


def weights(rows: int, cols: int) -> list[list[float]]:
    """The weight matrix that queries use: the same in every engine."""
    return [[((k * 7 + j * 3) % 11 - 5) / 10.0 for j in range(cols)] for k in range(rows)]


def attention_vector(width: int, shift: int = 0) -> list[float]:
    return [((k * 5 + shift) % 7 - 3) / 10.0 for k in range(width)]
