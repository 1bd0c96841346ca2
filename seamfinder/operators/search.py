"""The whole search: files, filter, blocks, rank, limits, session, merge."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analyzer
from ..functions.compounds import Lattice
from ..functions.tokens import Counter
from ..plans.query import Expr, compile_match, evaluate, keywords, leaves, parse
from ..sources import corpus, scratch
from . import blocks as B
from . import pattern, rank, segment, session, spans


def plain(word: str) -> list[str]:
    """The unstemmed analyzer, on the driver."""
    import regex

    return [w for w in regex.split(analyzer.SPLIT, word.lower()) if w]


def search_documents(files: DataFrame, query: str, n: int = 10, exact: bool = False, **how) -> DataFrame:
    """The best n files for a query, whole files as blocks: (path, score, rank)."""
    e = parse(query, plain, exact)
    found = rank.bm25(files, e, None, text="content", **how)
    return rank.top(found.select("path", "score"), n, "path")


def file_filter(files: DataFrame, query: str, files_level: bool = True) -> DataFrame:
    """Files that match, by the words of the whole file."""
    e = parse(query, plain)
    has = lambda k, exact: F.lower(F.col("content")).contains(k) if exact else analyzer.has_word(F.col("content"), k)
    return files.where(compile_match(e, has, files_level))


def line_hits(files: DataFrame, terms: list[str], *keep: str) -> DataFrame:
    """(path, line_no, term): a line of 2000 bytes at most contains a term, whatever the case."""
    rows = corpus.lines(files, *(keep or ("path",))).where(F.octet_length("line") <= corpus.LINE_BYTES)
    low = F.lower(F.col("line"))
    there = F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return rows.select(*(keep or ("path",)), "line_no", F.explode(there).alias("term"))


SHOWN = ["path", "start", "end", "node_type", "score", "rank", "matched_keywords", "block_unique_terms", "block_total_matches", "code"]
#: A block that is hit: rows of ``hit_blocks``.
HIT = "path string, start int, end int, node_type string, code string, tokens array<string>"


def chosen(content: str, ext: str, hits: set[int], tests: bool = True) -> list[tuple[int, int, str]]:
    """Ranges (start, end, kind) that hit lines of a text stand for, in order of their starts.

    A line in a comment stands for the block that the comment belongs to, with
    the comment; any other for the smallest block around it (a type declared in
    a function for the function), attributes above included. Of nested ones
    some go (settled). Lines in no block stand for the lines around them,
    merged. tests: whether blocks that are tests count; their lines stand for
    nothing else then.
    """
    found, comments = segment.forest(content, ext)
    n = content.count("\n") + (0 if content.endswith("\n") else 1) or 1
    noted = {line: c for c in comments for line in range(c.start, c.end + 1)} if hits else {}
    ranges: dict[tuple[int, str], int] = {}
    outside, open_, k = [], [], 0
    for line in sorted(hits):
        while k < len(found) and found[k].first <= line:
            open_.append(k)
            k += 1
        open_ = [i for i in open_ if found[i].end >= line]
        c = noted.get(line)
        around = [found[c.block]] if c and c.block >= 0 else sorted((found[i] for i in open_), key=lambda b: b.end - b.first)
        if not around:
            outside.append(line)
            continue
        b = around[0]
        if b.kind == "type_declaration" and b.parent >= 0 and found[b.parent].kind in ("function_declaration", "method_declaration"):
            b = found[b.parent]
        if b.is_test and not tests:
            continue
        start, end = (min(c.start, b.start), max(c.end, b.end)) if c and c.block >= 0 else (b.first if line < b.start else b.start, b.end)
        ranges[end, b.kind] = min(start, ranges.get((end, b.kind), start))
    out = segment.settled([(s, e, kind) for (e, kind), s in ranges.items()])
    around = spans.CONTEXT
    gap = 8 if len(outside) > 10 else 6 if len(outside) > 5 else 1
    windows: list[list[int]] = []
    for line in outside:
        s, e = max(1, line - around), min(n, line + around)
        if windows and s <= windows[-1][1] + 1 + gap:
            windows[-1][1] = max(e, windows[-1][1])
        else:
            windows.append([s, e])
    return sorted([*out, *((s, e, "context") for s, e in windows)])


def hit_blocks(files: DataFrame, e: Expr, tests: bool = True, words: bool = True, lattice: Lattice | None = None) -> DataFrame:
    """(path, start, end, node_type, code, tokens): what of files(path, ext, content[, seen]) a query hits, in one pass over each file.

    Lines that hint at a keyword are found by one automaton. Files whose words
    can't match, exclusions aside, have no hits; of the others' lines those in
    the ranges ``seen`` are passed over, and the rest stand for blocks (chosen). If
    the query only excludes, all lines count. tokens are the words of the block
    and of its file's name. Null texts have no hits.
    """
    terms = [t for t in keywords(e) if any(t in x.keywords and not x.excluded for x in leaves(e))]
    matcher = pattern.Matcher(e, terms, lattice)
    literal = {k for t in leaves(e) if t.exact for k in t.keywords}

    def present(found: dict[int, set[int]], content: str, path: str | None, own: Lattice | None) -> set[str]:
        """The keywords that a file or its name has as words."""
        has = {terms[i] for which in found.values() for i in which if terms[i] in literal} | (set(analyzer.forms(path or "", own)) & set(terms))
        lines = content.split("\n")
        for n in found:
            if len(has) == len(terms):
                break
            has |= set(analyzer.forms(lines[n - 1], own)) & set(terms)
        return has

    shared = lattice and files.sparkSession.sparkContext.broadcast(lattice)  # its size is bounded

    def run(batches):
        own = shared.value if shared else None
        for b in batches:
            rows = []
            for path, ext, content, seen in zip(*(c.to_pylist() for c in b.columns)):
                content = content or ""
                found = matcher.lines(content, own)
                hits = set(found) if terms else set(range(1, content.count("\n") + 2)) if content else set()
                if hits and terms and not evaluate(e, present(found, content, path, own), files=True):
                    continue
                if seen:
                    hits = {n for n in hits if not any(x["start"] <= n <= x["end"] for x in seen)}
                if not hits:
                    continue
                lines = [x if len(x) <= corpus.SHOWN_BYTES // 4 or len(x.encode("utf-8", "surrogatepass")) <= corpus.SHOWN_BYTES else "" for x in content.split("\n")]
                for s, t, kind in chosen(content, ext or "", hits, tests):
                    code = "\n".join(lines[s - 1 : t])
                    rows.append((path, s, t, kind, code, analyzer.tokenize(code, lattice=own) + analyzer.tokenize(path, lattice=own) if words else None))
            cols = zip(*rows) if rows else [()] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in HIT.split(", ")])

    seen = F.col("seen") if "seen" in files.columns else F.lit(None).cast("array<struct<start:int,end:int>>")
    return files.select("path", "ext", "content", seen.alias("seen")).mapInArrow(run, HIT)


def possible(files: DataFrame, e: Expr, lattice: Lattice | None = None) -> DataFrame:
    """Files whose whole text can match: the query over hints, exclusions aside; all that have a text, if it only excludes."""
    hints = pattern.hints(e, lattice)
    if all(t.excluded for t in leaves(e)):
        return files
    return files.where(compile_match(e, lambda k, _: pattern.contains(F.concat_ws("\n", "path", "content"), hints[k]), files=True) & rank.some_of([pattern.contains(F.col("content"), h) for h in hints.values()]))


#: Bounds of scores are rounded up to this, so that there are few different ones.
BOUND_STEP = 0.01


def early_hits(files: DataFrame, e: Expr, n: int, tests: bool = True, looked: list[int] | None = None, lattice: Lattice | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(hits, stats): hit blocks of as many files as it takes to be certain of the n best, and the statistics that their scores count with.

    One pass in the JVM tells which of the query's terms a file and its name
    have. From it come the statistics, by files (df and n; the mean length is
    that of a context window's words), and for each file a bound of what any of
    its blocks can score: a block has a word once or, if the file's name has it
    too, twice, and no kind of block counts for more than the highest boost.
    Files are divided into blocks in bands from the highest bound on, each band
    with files_needed files at least, until the n-th best score so far is above
    all bounds that are left. What is left out can't be among the n best, ties
    included. looked: gets the number of files of each band.
    """
    terms, some = keywords(e), pattern.hints(e, lattice)
    wanted = [i for i, t in enumerate(terms) if any(t in x.keywords and not x.excluded for x in leaves(e))]
    inside = {f"in_{i}": pattern.contains(F.col("content"), some[terms[i]]).cast("int") for i in wanted}
    named = {f"named_{i}": pattern.contains(F.col("path"), some[terms[i]]).cast("int") for i in wanted}
    per = files.select("path", analyzer.count_words(F.col("content")).alias("words"), B.line_count(F.col("content")).alias("lines"), *[c.alias(k) for k, c in (inside | named).items()])
    per = scratch.kept(per, "early")
    total = per.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("lines").alias("lines"), *[F.sum(F.greatest(f"in_{i}", f"named_{i}")).alias(f"df_{i}") for i in wanted]).first()
    stats = {f"df_{i}": float(total[f"df_{i}"] or 0) if i in wanted else 0.0 for i in range(len(terms))} | {"n": float(total.n), "avgdl": max(1.0, (total.words or 0) / max(1, total.lines or 0) * (2 * spans.CONTEXT + 1))}
    bound = F.lit(0.0)
    for i in wanted:
        tf, df = F.col(f"in_{i}") + F.col(f"named_{i}"), stats[f"df_{i}"]
        idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        bound = bound + F.when(tf > 0, idf * tf * (rank.K1 + 1) / (tf + rank.K1 * (1 - rank.B))).otherwise(0.0)
    bound = F.ceil(bound * max(rank.BOOSTS) / BOUND_STEP + 1).cast("long").alias("bound")
    bounds = scratch.kept(per.select("path", bound), "bounds")
    left = [(r.bound, r["count"]) for r in bounds.groupBy("bound").count().orderBy(F.desc("bound")).collect()]  # as many as there are steps to the highest score
    least, hits = rank.files_needed(n), None
    while left:
        band, size = [], 0
        while left and size < least:
            band.append(left.pop(0))
            size += band[-1][1]
        looked is None or looked.append(size)
        own = bounds.where(F.col("bound").between(band[-1][0], band[0][0])).select("path").distinct()
        new = scratch.kept(hit_blocks(files.join(own, "path", "left_semi"), e, tests, lattice=lattice), "hits")
        hits = new if hits is None else hits.unionByName(new)
        if left:
            best = scored(hits, e, stats).select("score").orderBy(F.desc("score")).limit(n).agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
            if best.n == n and best.low > left[0][0] * BOUND_STEP:
                break
            least *= 2  # so that there are few bands, however many files
    return (hit_blocks(files, e, tests, lattice=lattice) if hits is None else hits), stats


def scored(hits: DataFrame, e: Expr, stats: dict[str, float] | None = None) -> DataFrame:
    """Hit blocks that match, each once, with BM25 raised by their kind."""
    found = rank.bm25(hits.dropDuplicates(["path", "start", "end", "node_type"]), e, text="code", stats=stats)
    return found.withColumn("score", F.col("score") * rank.boost(F.col("node_type"), F.col("start"), F.col("end")))


def search(files: DataFrame, query: str, n: int | None = 10, max_bytes: int | None = None, max_tokens: int | None = None, seen: DataFrame | None = None, merge_gap: int | None = 5, tests: bool = True, exact: bool = False, early: bool = False, lattice: Lattice | None = None, count: Counter | None = None, scorer: Callable[[str, list[str]], list[float]] | None = None) -> DataFrame:
    """Ranked blocks of source files: declarations that match, and the context of hits outside of any.

    exact: the query is one literal text, and blocks that hold it come in order
    of path and line, without a score. seen: ranges (path, start, end) not to
    be shown again, whether their paths begin with ``./`` or not. Files that
    can't match are left out first; the others are divided into blocks once,
    and what is hit is written to the shared folder, from which statistics,
    ranks and limits are taken. A file that is there repeatedly counts once.
    Scores count the blocks that are hit in files that can match. early: they
    count files instead, and no more files are divided into blocks than it
    takes to be certain of the n best (early_hits). lattice: the words of a
    corpus by which compounds are divided (compounds.Lattice.of). count: counts
    tokens exactly where there is a limit on them. scorer: reads the query and
    the best blocks, and puts these in its own order (rank.rescored) before the
    limits hold. Null texts
    have no hits, an empty table gives an empty result, and columns beside
    path, ext and content aren't read.
    """
    e = parse(query, lambda w: analyzer.tokenize(w, lattice=lattice), exact)
    terms = keywords(e)
    files = files.select("path", "ext", "content")
    given = possible(files if tests else files.where(~corpus.is_test(F.col("path"))), e, lattice)
    if seen is not None:
        s = seen.groupBy(session.normal_path(F.col("path")).alias("p")).agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("seen"))
        given = given.join(s, session.normal_path(F.col("path")) == F.col("p"), "left")
    if exact:
        found = scratch.kept(hit_blocks(given, e, tests, False, lattice), "hits").dropDuplicates(["path", "start", "end", "node_type"]).orderBy("path", "start", "end")
        return (found if n is None else found.limit(n)).select("path", "start", "end", "node_type", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"), "code")
    if early and n is not None and not all(t.excluded for t in leaves(e)):
        hits, stats = early_hits(given, e, n, tests, lattice=lattice)
    else:
        hits, stats = scratch.kept(hit_blocks(given, e, tests, lattice=lattice), "hits"), None
    ranked = scored(hits, e, stats)
    ranked = ranked.select("path", "start", "end", "node_type", "code", "score", *rank.match_stats(F.col("tokens"), terms), (-F.col("score")).alias("minus"), F.octet_length("code").alias("bytes"), F.greatest(F.lit(1), F.floor(F.octet_length("code") / 4)).alias("tokens"))
    order = ["minus", "path", "start", "end"]
    if scorer:
        every = spans.limited(ranked, order, n) if n is not None else spans.running(ranked, order)
        ranked, order = rank.rescored(scratch.kept(every.drop("run_bytes", "run_tokens"), "scored"), query, scorer).withColumnRenamed("rank", "place"), ["place"]
    if count and max_tokens is not None:
        kept = spans.limited_tokens(ranked, order, max_tokens, count, "code", n, max_bytes)
    else:
        kept = spans.limited(ranked, order, n, max_bytes, max_tokens)
    if merge_gap is None:
        return kept.select(SHOWN).orderBy("rank")
    return merged(scratch.kept(kept.select(SHOWN), "ranked"), files, merge_gap, n is not None and n <= MOST_BROADCAST).orderBy("rank")


#: Result rows up to which they are sent to all tasks to find their files.
MOST_BROADCAST = 10_000


def merged(ranked: DataFrame, files: DataFrame, gap: int, few: bool = False) -> DataFrame:
    """Ranked blocks of one file that are near each other as one (spans.fixpoint), with the text between them.

    The best score and rank stay, keywords are put together, matches added up.
    A file's text is read again only where blocks are merged.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    many = ranked.groupBy("path").agg(F.count("*").alias("c")).where("c > 1").select("path")
    texts = files.join(F.broadcast(many) if few else many, "path", "left_semi").groupBy("path").agg(F.min("content").alias("content"))  # MOST_BROADCAST paths at most

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pdf.drop(columns="content")
        content = pdf["content"].iloc[0] or ""
        lines = ["" if len(x.encode("utf-8", "surrogatepass")) > corpus.SHOWN_BYTES else x for x in content.split("\n")]
        rows = []
        for start, end, kind, parts in spans.fixpoint(list(zip(pdf["start"], pdf["end"], pdf["node_type"], pdf["rank"])), gap):
            own = pdf.iloc[parts]
            code = own["code"].iloc[0] if len(parts) == 1 else spans.with_gaps(lines, start, end, list(zip(own["start"], own["end"])))
            rows.append((own["path"].iloc[0], start, end, kind, own["score"].max(), own["rank"].min(), sorted({k for ks in own["matched_keywords"] for k in ks}), own["block_unique_terms"].max(), own["block_total_matches"].sum(), code))
        return pd.DataFrame(rows, columns=SHOWN)

    return ranked.join(texts, "path", "left").groupBy("path").applyInPandas(one, schema)
