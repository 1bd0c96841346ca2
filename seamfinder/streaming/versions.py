"""Tables whose rows belong to versions of a path: appended to by batches, read at their latest versions, compacted.

A table is a row of generations. A batch adds to the latest one: ``heads`` has a
row for each path and version (deleted ones too, so that old rows are void), and
``rows`` what the version consists of, in buckets by a key. Compaction writes the
next generation from what counts; it has its heads last, which is when readers
turn to it, and what is older can go. Batches and compactions come from one
writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADS = "path string, version long, deleted boolean, batch long"


class Versions:
    """schema: of the rows beside path and version; key: the column by which they are in buckets."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "path", buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def generation(self) -> int:
        """The latest one that is whole; 0 is there before anything is written."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [str(x.getPath().getName()) for x in system.listStatus(top)] if system.exists(top) else []
        return max([0, *(int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdigit() and self._exists(f"{self.root}/{n}/heads/_SUCCESS"))])

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def append(self, heads: DataFrame, rows: DataFrame, batch: int = 0) -> None:
        """heads(path, version, deleted), rows(path, version, ...). A batch that is written again after a failure changes nothing, as equal rows count once."""
        at = f"{self.root}/gen-{self.generation()}"
        self._write(rows, f"{at}/rows", "append")
        heads.select("path", "version", "deleted", F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{at}/heads")

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        placed = rows.withColumn("bucket", self._bucket(F.col(self.key)))
        placed.repartition("bucket").sortWithinPartitions("bucket", self.key).write.mode(mode).partitionBy("bucket").parquet(path)

    def heads(self) -> DataFrame:
        """(path, version): the latest version of each path that isn't deleted."""
        at = f"{self.root}/gen-{self.generation()}/heads"
        if not self._exists(at):
            return self.spark.createDataFrame([], "path string, version long")
        last = self.spark.read.schema(HEADS).parquet(at).groupBy("path").agg(F.max(F.struct("version", "deleted")).alias("h"))
        return last.where("not h.deleted").select("path", "h.version")

    def rows(self, *keys: str) -> DataFrame:
        """Rows of the latest versions; with keys, only theirs, for which only their buckets are read."""
        at, schema = f"{self.root}/gen-{self.generation()}/rows", f"path string, version long, {self.schema}"
        if not self._exists(at):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(f"{schema}, bucket int").parquet(at)
        if keys:
            own = sorted({r[0] for r in self.spark.createDataFrame([(k,) for k in keys], "k string").select(self._bucket(F.col("k"))).collect()})
            found = found.where(F.col("bucket").isin(*own) & F.col(self.key).isin(*keys))
        return found.drop("bucket").join(self.heads(), ["path", "version"], "left_semi").distinct()

    def compact(self) -> None:
        """The next generation: what counts now, and nothing else."""
        now = self.generation()
        new = f"{self.root}/gen-{now + 1}"
        self._write(self.rows(), f"{new}/rows", "overwrite")
        self.heads().select("path", "version", F.lit(False).alias("deleted"), F.lit(-1).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{new}/heads")
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/gen-{now}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
