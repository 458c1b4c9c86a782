"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, deleted when the
    driver's JVM ends.  A temporary folder serves local masters only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(root or f'file://{tempfile.gettempdir()}').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, found = place(spark, path)
    fs.deleteOnExit(found)
    return path
