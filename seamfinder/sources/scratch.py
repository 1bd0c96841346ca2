"""Tables that a query writes for itself in the folder the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, local mode has a temporary folder instead, and on a cluster it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return "file://" + os.path.join(tempfile.gettempdir(), "seamfinder-shared")


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again, so that what reads it repeatedly doesn't make it repeatedly, and lost executors cost no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seamfinder/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"
    atexit.register(_forget, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
