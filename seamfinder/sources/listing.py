"""Folders listed level by level as Spark jobs, with the rules of .gitignore files that they inherit.

Each level's folders are rows; tasks list them, and the folders that they find are
the next level. So neither the driver nor one task walks a tree, a cut-off by
depth costs nothing below it, and what a folder inherits goes with its row.
"""

from __future__ import annotations

import contextlib
import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .ignore import GitIgnore

#: Folders that a task lists at most, about; bytes of a .gitignore file that are read.
FOLDERS, RULE_BYTES = 200, 1 << 20
ENTRY = "path string, name string, depth int, is_dir boolean, size long, modified timestamp, rules array<struct<folder:string,text:string>>"


def file_system(uri: str):
    """(a file system of pyarrow's, the path in it); tasks use it, as Spark's own readers aren't at hand there."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def listed(spark: SparkSession, root: str, globs: tuple[str, ...] = (), depth: int | None = None, gitignore: bool = True, hidden: bool = False) -> DataFrame:
    """(path, name, depth, is_dir, size, modified): files and folders below root; paths are relative to it, depth is 1 for what is in it.

    globs: names that are left out, and with a folder all below it. Rules of
    .gitignore files hold below the folders that have them unless switched off.
    hidden: whether names that begin with a point are there. Links to folders
    aren't followed, what is neither a file nor a folder isn't there, folders
    that can't be read are empty, and a root that isn't there gives an empty
    table. depth: levels that are listed at most.
    """
    base = root if urlparse(root).scheme not in ("", "file") else os.path.abspath(re.sub(r"^file:/*", "/", root))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        system, top = file_system(base)
        for pdf in batches:
            rows = []
            for folder, level, inherited in zip(pdf["path"], pdf["depth"], pdf["rules"]):
                here = f"{top.rstrip('/')}/{folder}" if folder else top
                try:
                    found = system.get_file_info(pafs.FileSelector(here))
                except (FileNotFoundError, NotADirectoryError, PermissionError, OSError):
                    continue
                rules = [dict(x) for x in inherited]
                ignore = GitIgnore()
                if gitignore and any(x.base_name == ".gitignore" and x.is_file for x in found):
                    with contextlib.suppress(OSError), system.open_input_stream(f"{here.rstrip('/')}/.gitignore") as f:
                        rules.append({"folder": folder, "text": f.read(RULE_BYTES).decode("utf-8", "replace")})
                for x in rules:
                    ignore.read("/" + x["folder"] if x["folder"] else "", x["text"])
                for x in found:
                    if not (x.is_file or x.type == pafs.FileType.Directory) or (x.base_name.startswith(".") and not hidden) or any(fnmatchcase(x.base_name, g) for g in globs):
                        continue
                    own, is_dir = f"{folder}/{x.base_name}" if folder else x.base_name, x.type == pafs.FileType.Directory
                    if ignore("/" + own, is_dir) or is_dir and isinstance(system, pafs.LocalFileSystem) and os.path.islink(f"{here}/{x.base_name}"):
                        continue
                    rows.append((own, x.base_name, int(level) + 1, is_dir, None if is_dir else x.size, x.mtime, rules if is_dir else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.sub(r"<.*>", "", ENTRY).split(", ")])

    level = spark.createDataFrame([("", 0, [])], "path string, depth int, rules array<struct<folder:string,text:string>>")
    found, count, at = [], 1, 0
    while count and (depth is None or at < depth):
        at += 1
        new = scratch.kept(level.repartition(max(1, -(-count // FOLDERS))).mapInPandas(entries, ENTRY), f"level-{at}")
        found.append(new.drop("rules"))
        level = new.where("is_dir").select("path", "depth", "rules")
        count = level.count()
    none = spark.createDataFrame([], ENTRY).drop("rules")
    return reduce(DataFrame.unionByName, found, none)


def contents(files: DataFrame, root: str) -> DataFrame:
    """files(path, size, ...) with ``content``: the text below root, read by the tasks that hold the rows, undecodable bytes replaced. Files that are gone by then have null."""
    base = root if urlparse(root).scheme not in ("", "file") else os.path.abspath(re.sub(r"^file:/*", "/", root))

    def read(path: pd.Series) -> pd.Series:
        system, top = file_system(base)

        def one(p: str) -> str | None:
            try:
                with system.open_input_stream(f"{top.rstrip('/')}/{p}", compression=None) as f:
                    return f.read().decode("utf-8", "replace")
            except OSError:
                return None

        return path.map(one)

    return files.withColumn("content", F.pandas_udf(read, "string")("path"))


def tree(entries: DataFrame, folder: str = "") -> DataFrame:
    """(path, line): what is in a folder, its folders first, each a line with its kind, size and name, in the order to be shown."""
    inside = entries.where(F.col("path") == F.concat(F.lit(f"{folder}/" if folder else ""), F.col("name")))
    kind = F.when(F.col("is_dir"), F.concat(F.lit("dir   "), F.lpad(F.lit("-"), 10, " "))).otherwise(F.concat(F.lit("file  "), F.lpad(size_text(F.col("size")), 10, " ")))
    return inside.select("path", F.concat(kind, F.lit("  "), F.col("name")).alias("line"), "is_dir", "name").orderBy(F.desc("is_dir"), "name").select("path", "line")


def size_text(size: Column) -> Column:
    """A size in bytes, or in the largest unit of 1024 that it comes to, with a decimal."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.concat(F.format_number(size / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def matching(entries: DataFrame, glob: str) -> DataFrame:
    """Files whose path matches a glob: ``*`` and ``?`` stay within a folder, ``**`` doesn't; without a slash the name alone is matched."""
    column = F.col("path") if "/" in glob else F.col("name")
    return entries.where(~F.col("is_dir") & column.rlike(f"^(?:{GitIgnore.pattern(glob)})$"))
