"""Blocks of source files as a table, what lies in them, and what a target asks to be taken out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import LANGUAGES, extensions, is_test
from . import spans, trees
from .segment import segment

SCHEMA = "path string, block_id int, start int, end int, first int, node_type string, name string, parent string, parent_type string, parent_start int, parent_end int, is_test boolean, code string"
#: Lines shown around a line that is in no block.
AROUND = 10


def line_count(content: Column) -> Column:
    """Lines of a text; a newline at its end begins none. Null has one, as an empty text has."""
    text = F.coalesce(content, F.lit(""))
    return F.greatest(F.lit(1), F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0))


def blocks(files: DataFrame) -> DataFrame:
    """Blocks of files(path, ext, content); files of unknown languages and null texts have none.

    start and end are the declaration's lines, first where the comments and
    attributes above it begin; parent is the declaration around it. Repeated
    files give their blocks each time; other columns aren't read.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"]):
                lines, found = (content or "").split("\n"), segment(content or "", ext or "")
                for i, b in enumerate(found):
                    up = found[b.parent] if b.parent >= 0 else None
                    rows.append((path, i, b.start, b.end, b.first, b.kind, b.name or None, up and up.name or None, up and up.kind, up and up.start, up and up.end, b.is_test, "\n".join(lines[b.start - 1 : b.end])))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield out.astype({"parent_start": "Int32", "parent_end": "Int32"})

    return files.select("path", "ext", "content").mapInPandas(run, SCHEMA)


def enclosing(hits: DataFrame, found: DataFrame) -> DataFrame:
    """For each hit (path, line_no) the smallest block that holds it, comments above it included.

    A hit above a declaration takes in the comments; a type declared inside a
    function is widened to the function.
    """
    b = found.select(F.col("path").alias("p"), "block_id", "start", "end", "first", "node_type", "name", "parent_type", "parent_start", "parent_end", "is_test")
    j = hits.join(b, (F.col("path") == F.col("p")) & F.col("line_no").between(F.col("first"), F.col("end")))
    local = (F.col("node_type") == "type_declaration") & F.coalesce(F.col("parent_type").isin("function_declaration", "method_declaration"), F.lit(False))
    start = F.when(local, F.col("parent_start")).when(F.col("line_no") < F.col("start"), F.col("first")).otherwise(F.col("start"))
    own = F.struct("block_id", start.alias("start"), F.when(local, F.col("parent_end")).otherwise(F.col("end")).alias("end"), F.when(local, F.col("parent_type")).otherwise(F.col("node_type")).alias("node_type"), "name", "is_test")
    return j.groupBy("path", "line_no").agg(F.min_by(own, F.struct(F.col("end") - F.col("first"), F.col("block_id"))).alias("b")).select("path", "line_no", "b.*")


def _unknown(ext: str) -> Column:
    """Whether no segmenter knows an extension."""
    return ~F.coalesce(F.lower(ext).isin(*[x for xs in LANGUAGES.values() for x in xs]), F.lit(False))


def _lines_of(content: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.split(F.coalesce(content, F.lit("")), "\n", -1), start, end - start + 1), "\n")


def symbol(found: DataFrame, name: str, files: DataFrame | None = None, around: int = AROUND) -> DataFrame:
    """Blocks by name or Parent.name. Files (if given) without such a block give the lines around the first that has the text; those of unknown languages are given whole."""
    parent, _, own = name.rpartition(".")
    hit = found.where((F.col("name") == own) & (F.col("parent") == parent if parent else F.lit(True))).select("path", "start", "end", "node_type", "code")
    if files is None:
        return hit
    rest = files.select("path", "ext", "content").join(hit.select("path").distinct(), "path", "left_anti").where(F.col("content").contains(own))
    at = F.size(F.split(F.substring_index("content", own, 1), "\n", -1))
    n = line_count(F.col("content"))
    whole = _unknown("ext")
    rest = rest.select("path", "content", F.when(whole, 1).otherwise(F.greatest(F.lit(1), at - around)).alias("start"), F.when(whole, n).otherwise(F.least(n, at + around)).alias("end"), F.when(whole, "file").otherwise("text_search").alias("node_type"))
    return hit.unionByName(rest.select("path", "start", "end", "node_type", _lines_of(F.col("content"), F.col("start"), F.col("end")).alias("code")))


def extract(files: DataFrame, found: DataFrame, wanted: DataFrame, around: int = AROUND, distinct: bool = False) -> DataFrame:
    """wanted(path, start[, end, symbol, lines]) -> (path, start, end, node_type, code).

    By what a target has: a symbol, a range (start and end), a line (start), a
    set of lines, or a whole file. Lines are moved into the file. Ranges, lines
    and sets give one piece that covers the smallest blocks around each of
    their lines; where there is no block, a range gives its own lines, and a
    line or a set those around it. distinct: pieces inside of others go.
    Targets of files that aren't there give nothing, repeated targets one
    piece; null texts count as empty.
    """
    kinds = {"start": "int", "end": "int", "symbol": "string", "lines": "array<int>"}
    w = wanted.select("path", *[F.col(c).cast(t) if c in wanted.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).distinct()
    text = files.select("path", "ext", F.coalesce("content", F.lit("")).alias("content"), line_count(F.col("content")).alias("n"))
    ask = F.when(F.col("symbol").isNotNull(), "symbol").when(F.col("end").isNotNull() & F.col("start").isNotNull(), "range").when(F.col("start").isNotNull(), "line").when(F.size(F.coalesce("lines", F.array())) > 0, "lines").otherwise("file")
    into = lambda c: F.greatest(F.lit(1), F.least(c, F.col("n")))
    asked = w.withColumn("ask", ask).join(text.select("path", "n"), "path").withColumn("ws", F.when(F.col("start").isNotNull(), into(F.col("start")))).withColumn("we", F.when(F.col("end").isNotNull(), F.greatest(F.col("ws"), into(F.col("end")))))
    extra = F.transform(F.coalesce("lines", F.array().cast("array<int>")), into)
    own = F.when(F.col("ask") == "range", F.sequence("ws", "we")).when(F.col("ask") == "line", F.array("ws")).otherwise(F.array().cast("array<int>"))
    key = ["path", "ask", "start", "end", "lines", "ws", "we", "n"]
    per = asked.where(F.col("ask").isin("range", "line", "lines")).select(*key, F.explode(F.array_distinct(F.concat(own, extra))).alias("line_no"))
    near = enclosing(per.select("path", "line_no").distinct(), found).select("path", "line_no", F.col("start").alias("bs"), F.col("end").alias("be"))
    g = per.join(near, ["path", "line_no"], "left").groupBy(*key).agg(F.min("bs").alias("bs"), F.max("be").alias("be"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    block, is_range = F.col("bs").isNotNull(), F.col("ask") == "range"
    kind = F.when(block, F.when(is_range, "merged_ast_range").when(F.col("ask") == "line", "merged_ast_line").otherwise("merged_ast_specific_lines")) \
        .otherwise(F.when(is_range, "range").when(F.col("ask") == "line", "context").otherwise("specific_lines"))
    lo, hi = F.when(F.col("ask") == "lines", F.col("lo")).otherwise(F.col("ws")), F.when(F.col("ask") == "lines", F.col("hi")).otherwise(F.coalesce("we", "ws"))
    pad = F.when(is_range, 0).otherwise(around)
    placed = g.select("path", F.when(block, F.col("bs")).otherwise(into(lo - pad)).alias("start"), F.when(block, F.least("be", "n")).otherwise(into(hi + pad)).alias("end"), kind.alias("node_type"))
    placed = placed.unionByName(asked.where("ask = 'file'").select("path", F.lit(1).alias("start"), F.col("n").alias("end"), F.lit("file").alias("node_type")))

    s = asked.where("ask = 'symbol'").select("path", "symbol", "n", F.substring_index("symbol", ".", -1).alias("own"), F.when(F.col("symbol").contains("."), F.element_at(F.split("symbol", r"\."), -2)).alias("above"))
    b = found.select(F.col("path").alias("p"), F.col("start").alias("bs"), F.col("end").alias("be"), F.col("node_type").alias("kind"), "name", "parent")
    named = s.join(b, (F.col("path") == F.col("p")) & (F.col("own") == F.col("name")) & (F.col("above").isNull() | (F.col("above") == F.col("parent"))), "left")
    hit = named.where("bs is not null").select("path", F.col("bs").alias("start"), F.col("be").alias("end"), F.col("kind").alias("node_type"))
    miss = named.where("bs is null").select("path", "own", "n").join(text.select("path", "ext", "content"), "path").where(F.expr("contains(content, own)"))
    at, whole = F.expr(r"size(split(substring_index(content, own, 1), '\n', -1))"), _unknown("ext")
    miss = miss.select("path", F.when(whole, 1).otherwise(into(at - around)).alias("start"), F.when(whole, F.col("n")).otherwise(into(at + around)).alias("end"), F.when(whole, "file").otherwise("text_search").alias("node_type"))
    pieces = placed.unionByName(hit).unionByName(miss).distinct()
    if distinct:
        pieces = pieces.join(spans.contained(pieces.select("path", "start", "end")), ["path", "start", "end"]).dropDuplicates(["path", "start", "end"])
    return pieces.join(text.select("path", "content"), "path").select("path", "start", "end", "node_type", _lines_of(F.col("content"), F.col("start"), F.col("end")).alias("code"))


def match_pattern(content: str, pattern: str, ext: str = "rs") -> list[tuple[int, int]]:
    """Offsets where a pattern matches a text in the language of an extension."""
    return trees.matches(content, ext, trees.compiled(pattern))


MATCHED = "path string, line_start int, line_end int, column_start int, column_end int, matched_text string"


def structural(files: DataFrame, pattern: str, language: str | None = None, tests: bool = True, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, line_start, line_end, column_start, column_end, matched_text), in order of path and place: where a pattern of code matches the trees of files(path, ext, content) (trees).

    Files of unknown languages and null texts match nothing; tests, ignore:
    whether files of tests count, and texts that a path may not have. Repeated
    files give their matches each time; other columns aren't read.
    """
    wanted = trees.compiled(pattern)
    given = files.where(~_unknown("ext"))
    given = given if language is None else given.where(F.lower("ext").isin(*extensions(language)))
    given = given if tests else given.where(~is_test(F.col("path")))
    for x in ignore:
        given = given.where(~F.col("path").contains(x))

    def run(batches):
        for pdf in batches:
            rows = []
            for path, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"]):
                content = content or ""
                for s, e in trees.matches(content, ext, wanted):
                    place = lambda o: (content.count("\n", 0, o) + 1, o - (content.rfind("\n", 0, o) + 1))  # noqa: B023, E731
                    (a, b), (c, d) = place(s), place(e)
                    rows.append((path, a, c, b, d, content[s:e]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MATCHED.split(", ")])

    return given.select("path", "ext", "content").mapInPandas(run, MATCHED).orderBy("path", "line_start", "column_start", "line_end", "column_end")
