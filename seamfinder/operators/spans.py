"""Operators on line ranges and ordered rows: windows of context, merging, containment, limits, sessions, diffs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import Counter
from ..sources import scratch
from .session import normal_path

CONTEXT = 5


def islands(ranges: DataFrame, key: str = "path", gap: int | str = 0) -> DataFrame:
    """(key, start, end) with an island number: ranges that overlap or are ``gap`` lines apart share one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(gap) if isinstance(gap, str) else F.lit(gap)
    return ranges.withColumn("new", F.when(before.isNull() | (F.col("start") > before + 1 + apart), 1).otherwise(0)).withColumn("island", F.sum("new").over(w)).drop("new")


def merge(ranges: DataFrame, key: str = "path", gap: int | str = 0, **aggregates) -> DataFrame:
    """One range an island; aggregates: more columns, by name."""
    return islands(ranges, key, gap).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts"), *[v.alias(k) for k, v in aggregates.items()]).drop("island")


#: Lines between two ranges up to which they are merged, and lines of a gap from which it is left out.
APART, LEFT_OUT = 5, 10
_CALLABLE = ("function", "method", "fn", "func")


def apart(a: tuple[int, int, str], b: tuple[int, int, str], most: int = APART) -> bool:
    """Whether ranges (start, end, kind) are too far from each other to be one; a comment and what can be called may be twice as far."""
    gap = max(0, max(a[0], b[0]) - min(a[1], b[1]) - 1)
    pair = any("comment" in x and any(f in y for f in _CALLABLE) for x, y in ((a[2], b[2]), (b[2], a[2])))
    return gap > most * (2 if pair else 1)


def fixpoint(ranges: list[tuple[int, int, str, int]], most: int = APART) -> list[tuple[int, int, str, list[int]]]:
    """Ranges (start, end, kind, rank) of one file merged until nothing is near enough: (start, end, kind, places of the parts).

    In the order of starts, each that is left takes in all that are near
    enough, again and again, as it grows; its kind becomes that of a part with a
    better rank than its first one, and with the kind what is near enough. So
    the result depends on the order, which sums over islands can't express.
    """
    order = sorted(range(len(ranges)), key=lambda i: (ranges[i][0], ranges[i][1], ranges[i][3]))
    left, out = dict.fromkeys(order), []
    for i in order:
        if i not in left:
            continue
        del left[i]
        start, end, kind, rank = ranges[i]
        parts, grown = [i], True
        while grown:
            grown = False
            for j in list(left):
                s, e, k, r = ranges[j]
                if not apart((start, end, kind), (s, e, k), most):
                    start, end, kind = min(start, s), max(end, e), kind if rank <= r else k
                    parts.append(j)
                    del left[j]
                    grown = True
        out.append((start, end, kind, parts))
    return out


def with_gaps(lines: list[str], start: int, end: int, parts: list[tuple[int, int]]) -> str:
    """The text of a merged range: its parts, what is between them, and a note in place of gaps of LEFT_OUT lines or more."""
    out, at = [], start
    for s, e in [*sorted(parts), (end + 1, end + 1)]:
        if s - at >= LEFT_OUT:
            out.append(f"... lines {at}-{s - 1} skipped...")
        else:
            out += lines[at - 1 : s - 1]
        if s <= end:
            out += lines[max(s, at) - 1 : e]
        at = max(at, e + 1)
    return "\n".join(out)


def context_windows(hits: DataFrame, lengths: DataFrame, key: str = "path", around: int = CONTEXT) -> DataFrame:
    """Hit lines (key, line_no) widened and merged; files with many windows merge over wider gaps. lengths: (key, n_lines)."""
    wide = hits.join(lengths, key).select(key, F.greatest(F.lit(1), F.col("line_no") - around).alias("start"), F.least("n_lines", F.col("line_no") + around).alias("end"))
    n = F.count("*").over(Window.partitionBy(key))
    return merge(wide.withColumn("apart", F.when(n > 10, 8).when(n > 5, 6).otherwise(1)), key, "apart")


def contained(ranges: DataFrame, key: str = "path") -> DataFrame:
    """Ranges that lie in no other; equal ones stay once."""
    w = Window.partitionBy(key).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.dropDuplicates([key, "start", "end"]).withColumn("reach", F.max("end").over(w)).where("reach is null or end > reach").drop("reach")


def running(ranked: DataFrame, order: list[str]) -> DataFrame:
    """ranked with rank, run_bytes and run_tokens: places from 1 in the order, and sums of bytes and tokens up to each row, itself included.

    Rows are dealt by ranges of the whole order, so that no task sees all of
    them, however many tie in its first columns, and written; each part then
    adds its own sums to those of the parts before, a row for each part.
    """
    size = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("bytes", "tokens")}
    dealt = ranked.drop("rank", "run_bytes", "run_tokens").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    dealt = scratch.kept(dealt.withColumn("part", F.shiftright("mid", 33).cast("int")), "running")
    per = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(size["bytes"]).alias("b"), F.sum(size["tokens"]).alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    ahead = per.select(F.col("part").alias("of"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "nbt"])
    own = Window.partitionBy("part").orderBy("mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.join(F.broadcast(ahead), F.col("part") == F.col("of")).withColumns({  # a row for each part
        "rank": (F.col("n_before") + F.count("*").over(own)).cast("int"), "run_bytes": F.col("b_before") + F.sum(size["bytes"]).over(own), "run_tokens": F.col("t_before") + F.sum(size["tokens"]).over(own)})
    return rows.drop("part", "of", "mid", "n_before", "b_before", "t_before")


#: Bytes that stand for a token in the estimate, and how far beyond the limit by the estimate rows are counted at a time.
TOKEN_BYTES, BEYOND = 4, 1.1


def limited_tokens(ranked: DataFrame, order: list[str], max_tokens: int, count: Counter, text: str = "code", max_results: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Rows up to the first that would pass a limit, with rank and, as ``run_tokens``, the exact tokens up to each row.

    The estimate by bytes only tells which rows are counted: those up to BEYOND
    times the limit, and more while their exact sum doesn't pass it. So what
    stays is exact, and what sorts far later is never counted: the number of
    rows that are depends on the limit, not on the table. count gets their
    texts, null among them. order tells rows apart.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    sized = ranked.withColumns({"bytes": size, "tokens": F.greatest(F.lit(1), F.floor(size / TOKEN_BYTES))})
    rows = limited(sized, order, max_results, max_bytes) if max_results is not None else running(sized, order)
    rows = scratch.kept(rows if max_results is not None or max_bytes is None else rows.where(F.col("run_bytes") <= max_bytes), "limited")
    def counts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1).to_pylist()), pa.int64())], names=["place", "exact"])

    low, high, known = -1, int(max_tokens * BEYOND) + 1, None
    while True:
        part = rows.where((F.col("run_tokens") - F.col("tokens") > low) & (F.col("run_tokens") - F.col("tokens") <= high))
        new = scratch.kept(part.select("rank", text).mapInArrow(counts, "place int, exact long"), "counted")
        known = new if known is None else known.unionByName(new)
        total = known.agg(F.sum("exact").alias("n")).first().n or 0
        if total > max_tokens or rows.where(F.col("run_tokens") - F.col("tokens") > high).isEmpty():
            break
        low, high = high, 2 * high
    sums = known.withColumn("sum", F.sum("exact").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # as many rows as have tokens up to the limit, and some
    fits = rows.join(sums, F.col("rank") == F.col("place"))
    return fits.where(F.col("sum") <= max_tokens).select(*ranked.columns, "rank", F.col("sum").alias("run_tokens"))


def limited(ranked: DataFrame, order: list[str], max_results: int | None = None, max_bytes: int | None = None, max_tokens: int | None = None, skipped: bool = False) -> DataFrame:
    """Rows up to the first that would pass a limit, with running totals; or, as they are, all that sort after those.

    ranked has bytes and tokens, null counting as none; order tells its rows
    apart, ties are in any order. With a limit on results a top-k comes first.
    Without one, running totals are over the whole table (running).
    """
    def over(rows: DataFrame) -> Column:
        out = F.lit(False)
        for col, most in (("rank", max_results), ("run_bytes", max_bytes), ("run_tokens", max_tokens)):
            if most is not None:
                out = out | (F.col(col) > most)
        return out

    size = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("bytes", "tokens")}
    ranked = ranked.drop("rank", "run_bytes", "run_tokens")
    if max_results is not None:
        w = Window.orderBy(*order)
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = ranked.orderBy(*order).limit(max_results).withColumns({"rank": F.row_number().over(w), "run_bytes": F.sum(size["bytes"]).over(run), "run_tokens": F.sum(size["tokens"]).over(run)})
        kept = rows.withColumn("over", F.max(over(rows).cast("int")).over(run)).where("over = 0").drop("over")
    else:
        kept = running(ranked, order)
        kept = kept.where(~over(kept))  # totals never fall, so what passes a limit is a tail of the order
    if not skipped:
        return kept
    last = kept.agg(F.max(F.struct(*order)).alias("last"))  # null where no row is kept
    return ranked.crossJoin(F.broadcast(last)).where(F.col("last").isNull() | (F.struct(*order) > F.col("last"))).drop("last")


def unseen_lines(hits: DataFrame, seen: DataFrame) -> DataFrame:
    """Hits (path, line_no) outside the ranges (path, start, end) already shown in a session."""
    s = seen.select(normal_path(F.col("path")).alias("p"), "start", "end")
    return hits.join(s, (normal_path(F.col("path")) == F.col("p")) & F.col("line_no").between(F.col("start"), F.col("end")), "left_anti")


def unseen_blocks(blocks: DataFrame, seen: DataFrame) -> DataFrame:
    return blocks.join(seen.select("path", "start", "end"), ["path", "start", "end"], "left_anti")


def block_text(ranges: DataFrame, lines: DataFrame, key: str = "path") -> DataFrame:
    """ranges with their text, gaps filled from the file's lines."""
    r, n = ranges.select(key, "start", "end"), lines.select(F.col(key).alias("k"), "line_no", "line")
    j = r.join(n, (F.col(key) == F.col("k")) & F.col("line_no").between(F.col("start"), F.col("end")))
    return j.groupBy(key, "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("code"))


def diff_lines(diff: DataFrame, order: str = "pos", text: str = "line", key: str = "diff_id") -> DataFrame:
    """Added lines of unified diffs: (key, path, line_no), from running state over the lines of each diff."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hunk = F.when(F.col(text).rlike(r"^@@ -\d+(,\d+)? \+\d+"), F.regexp_extract(text, r"\+(\d+)", 1).cast("int"))
    rows = diff.withColumn("path", F.last(F.when(F.col(text).startswith("+++ b/"), F.expr(f"substring({text}, 7)")), ignorenulls=True).over(w)) \
        .withColumn("from", F.last(hunk, ignorenulls=True).over(w)).withColumn("hunk", F.count(hunk).over(w))
    own = Window.partitionBy(key, "path", "hunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = F.when(hunk.isNull() & ~F.col(text).startswith("-") & ~F.col(text).startswith("+++") & ~F.col(text).startswith("\\"), 1).otherwise(0)
    rows = rows.withColumn("line_no", F.col("from") + F.sum(counted).over(own) - 1)
    return rows.where((F.col("hunk") > 0) & F.col(text).startswith("+") & ~F.col(text).startswith("+++")).select(key, "path", "line_no")
