"""Probes of executed plans."""

from contextlib import contextmanager

#: Small enough for tests to have hot partitions, and no broadcasts.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split_joins(df) -> int:
    """Runs ``df`` and counts the joins of which partitions were split."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")
