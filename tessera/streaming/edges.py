"""Node degrees over a stream of edges (Structured Streaming).

The engine's graphs are batches; this keeps their one running statistic, the
degree, while edges still arrive.  Edges carry a time ``ts``: late ones beyond
the watermark are dropped and the window's state is released.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(begin, id, s): edges received by each node in each window of a streamed
    (ts, dst, src)."""
    timed = edges.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), F.col("dst").alias("id")).agg(F.count("*").alias("s")).select(F.col("w.start").alias("begin"), "id", "s")
