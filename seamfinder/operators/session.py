"""Sessions: what a user has been shown for a query isn't shown again, as long as its file stays as it was; time limits and timings."""

from __future__ import annotations

import contextlib
import hashlib
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "session_id string, query_hash string, path string, start int, end int, md5 string"


def session_id() -> str:
    """A new name: four hexadecimal digits."""
    return uuid.uuid4().hex[:4]


def query_hash(query: str) -> str:
    """The same query has the same hash everywhere."""
    return hashlib.blake2b(query.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def normal_path(path: Column) -> Column:
    """Without ``./`` at its beginning."""
    return F.regexp_replace(path, r"^(\./)+", "")


class Session:
    """Blocks shown so far, in a table that grows by what is shown; entries count by session and by query.

    A block goes with the md5 of its file. Where the file has another one now,
    or is gone, its blocks count as not shown.
    """

    def __init__(self, spark: SparkSession, table: str, name: str | None = None):
        self.spark, self.table, self.name = spark, table.rstrip("/"), name if name and name != "new" else session_id()

    def _all(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.table)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], BLOCKS)
        return self.spark.read.schema(BLOCKS).parquet(self.table)

    def seen(self, query: str, files: DataFrame) -> DataFrame:
        """(path, start, end) shown for the query, of files(path, content) that are as they were."""
        mine = self._all().where((F.col("session_id") == self.name) & (F.col("query_hash") == query_hash(query)))
        now = files.select(normal_path(F.col("path")).alias("path"), F.md5(F.coalesce("content", F.lit(""))).alias("md5"))
        return mine.join(now, ["path", "md5"], "left_semi").select("path", "start", "end").distinct()

    def add(self, query: str, shown: DataFrame, files: DataFrame) -> None:
        """Note what is shown: shown(path, start, end) of files(path, content). Repeated blocks are noted again, which changes nothing."""
        now = files.select(normal_path(F.col("path")).alias("path"), F.md5(F.coalesce("content", F.lit(""))).alias("md5"))
        rows = shown.select(normal_path(F.col("path")).alias("path"), F.col("start").cast("int"), F.col("end").cast("int")).distinct().join(now, "path")
        rows.select(F.lit(self.name).alias("session_id"), F.lit(query_hash(query)).alias("query_hash"), "path", "start", "end", "md5").write.mode("append").parquet(self.table)

    def unseen(self, query: str, blocks: DataFrame, files: DataFrame) -> DataFrame:
        """blocks (path, start, end, ...) without those shown for the query."""
        s = self.seen(query, files).select(F.col("path").alias("p"), F.col("start").alias("s"), F.col("end").alias("e"))
        return blocks.join(s, (normal_path(F.col("path")) == F.col("p")) & (F.col("start") == F.col("s")) & (F.col("end") == F.col("e")), "left_anti")


@contextlib.contextmanager
def timeout(spark: SparkSession, seconds: float):
    """Jobs started inside are cancelled after so many seconds; then TimeoutError is raised."""
    group, late = f"timeout-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, f"at most {seconds} s", True)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"timed out after {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(key, None)


class Timings:
    """Seconds by stage; a stage that is entered again adds up."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextlib.contextmanager
    def stage(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
