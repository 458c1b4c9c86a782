"""Joins whose hot keys adaptive execution can split, and shuffles whose number of
partitions follows their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that deals both sides; gone after the join.
DEALT = "_dealt"


def turned(df: DataFrame, key: str) -> Column:
    """A one-to-one function of a key that no earlier step has laid rows out by;
    null stays null."""
    if isinstance(df.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.bitwise_not(F.col(key).cast("long"))
    return F.when(F.col(key).isNotNull(), F.struct(key))


def dealt_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on their column ``key`` (the left one stays).

    A side that is an aggregate by the key, or another join on it, already lies by
    it, so Spark plans no shuffle of that side under the join; but only partitions
    of two shuffles can be split, so a hot key of the other side would stay in one
    task.  Here both sides are dealt by a function of the key: a shuffle more of
    the smaller side, and any hot key is split."""
    a, b = left.withColumn(DEALT, turned(left, key)), right.withColumn(DEALT, turned(right, key)).drop(key)
    return a.join(b, DEALT, how).drop(DEALT)


#: Bytes of a plan's estimate for each partition of ``spread``.
EACH = 1 << 20


def spread(df: DataFrame, like: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to a number of partitions that follows Spark's estimate
    of ``like``: adaptive execution would put partitions together up to a size of
    compressed bytes, which hold many times as much in memory.  Where the estimate is
    unknown (a local collection of rows, a join of joins) the plan stays as it is."""
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= 1 << 45 else df.repartition(1 + size // EACH, *keys)
