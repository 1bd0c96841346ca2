"""Blocks and postings of files, kept up to date from a stream of them.

The stream has (path, ext, content, version); null content deletes a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import analyzer
from ..operators import blocks as B
from ..operators import search as S
from ..plans.query import compile_match, keywords, leaves, parse
from .versions import Versions

#: Batches after which a table is compacted.
COMPACTED = 20


def block_table(spark: SparkSession, root: str) -> Versions:
    return Versions(spark, root, B.SCHEMA.removeprefix("path string, "))


def posting_table(spark: SparkSession, root: str) -> Versions:
    """Rows (term, n): how often a file has a term, its name's words included."""
    return Versions(spark, root, "term string, n long", key="term")


def _latest(batch: DataFrame) -> DataFrame:
    """A path's last version in a batch."""
    last = batch.groupBy("path").agg(F.max(F.struct("version", "ext", "content")).alias("x"))
    return last.select("path", "x.version", "x.ext", "x.content")


def _heads(files: DataFrame) -> DataFrame:
    return files.select("path", "version", F.isnull("content").alias("deleted"))


def add_blocks(table: Versions, batch: DataFrame, number: int = 0) -> None:
    files = _latest(batch)
    table.append(_heads(files), B.blocks(files).join(files.select("path", "version"), "path"), number)


def add_postings(table: Versions, batch: DataFrame, number: int = 0) -> None:
    files = _latest(batch)
    words = files.where("content is not null").select("path", "version", F.explode(F.concat(analyzer.all_terms(F.col("content")), analyzer.all_terms(F.col("path")))).alias("term"))
    table.append(_heads(files), words.groupBy("path", "version", "term").agg(F.count("*").alias("n")), number)


def maintain(stream: DataFrame, root: str, checkpoint: str, every: int = COMPACTED) -> StreamingQuery:
    """Keep tables of blocks and postings below root; all that is there is taken in, and each ``every`` batches they are compacted."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        tables = block_table(spark, f"{root}/blocks"), posting_table(spark, f"{root}/postings")
        for table, add in zip(tables, (add_blocks, add_postings)):
            add(table, batch, number)
            if number % every == every - 1:
                table.compact()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The blocks of the latest version of each path that isn't deleted."""
    return block_table(spark, f"{root}/blocks").rows().drop("version")


def candidates(table: Versions, query: str) -> DataFrame | None:
    """The paths whose words can match a query, by the postings of its terms alone; None where words can't tell (exact terms, or only exclusions)."""
    e = parse(query, analyzer.tokenize)
    if all(t.excluded for t in leaves(e)) or any(t.exact for t in leaves(e)):
        return None
    terms = [k for k in keywords(e) if any(k in t.keywords and not t.excluded for t in leaves(e))]
    has = table.rows(*terms).groupBy("path").agg(F.collect_set("term").alias("terms"))  # the query's terms at most
    return has.where(compile_match(e, lambda k, _: F.array_contains("terms", k), files=True)).select("path")


def search(files: DataFrame, table: Versions, query: str, *args, **how) -> DataFrame:
    """The whole search over files, of which only those are read into blocks that the postings name."""
    some = None if how.get("exact") else candidates(table, query)
    return S.search(files if some is None else files.join(some, "path", "left_semi"), query, *args, **how)
