"""Pieces the training-data operators share: scratch tables, components, rules for columns."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import tempfile
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between two runs of it is a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, local mode has the
    driver's own temporary folder instead; on a cluster it is an error, as
    executors don't see each other's folders.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = "file://" + os.path.join(tempfile.gettempdir(), "seamfinder-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lost executors cost a task and no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/seamfinder/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"
        atexit.register(self._forget, self.root)

    def _forget(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may be gone; its files then stay for the cluster's own cleaning
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again with the same schema."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
        for _ in range(2):  # what the first pass finds holds what the second one does
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *names: str) -> None:
        for name in names:
            self._forget(self.path(name))


#: Bytes of an Arrow batch that goes to Python, about; a session's own setting goes before.
BATCH_BYTES = 4 << 20


def arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with batches bounded in bytes, as texts may be long; a worker gives its memory back when a task is done."""
    limit, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if int(spark.conf.get(limit, None) or 2**31 - 1) == 2**31 - 1:
        spark.conf.set(limit, str(BATCH_BYTES))

    def whole(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Free what the allocators of Arrow and C hold without need; workers live on, and other stages need the room."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def filesystem(uri: str):
    """A pyarrow file system and the path in it; executors use it for binary files."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of edges(a, b), by alternating large-star and small-star steps.

    Returns (node, root), root being the smallest node of the component; nodes
    without an edge to another are absent. Each step is joins and aggregates
    over the edge table, written to the shared folder; no step gathers a node's
    neighbours, so hubs cost no more than their edges.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = scratch.keep(e, f"{name}-0")
    state, step = _state(e), 0
    while state[0]:
        step += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        # large star: every neighbour above x goes to the smallest of x and its neighbours
        large = e.join(low, e.v == low.x).select("u", F.col("m").alias("v")).where("u > v").distinct()
        near = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        # small star: x and its neighbours below it go to the smallest of those
        small = large.join(near, large.u == near.x).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        new = scratch.keep(small.unionByName(near.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        e, before = new, state
        state = _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))\
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
