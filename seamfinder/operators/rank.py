"""Corpus statistics, BM25, boosts and the early score."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analyzer
from ..plans.query import Expr, compile_match, compile_score, keywords, leaves

K1, B = 1.5, 0.5
EARLY_K1, EARLY_B = 1.2, 0.75
#: Queries have at most this many distinct keywords.
MOST_KEYWORDS = 256


def occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(term)))


def bm25(blocks: DataFrame, e: Expr, tokens: str | None = "tokens", text: str | None = None, k1: float = K1, b: float = B, set_tf: bool = False, corpus_wide: bool = False, stats: dict[str, float] | None = None) -> DataFrame:
    """blocks that match, with a score.

    Candidates are blocks with some keyword (all blocks if the query only
    excludes); N, df and the mean length are over candidates, or over all
    blocks if corpus_wide, or given as ``stats`` (n, avgdl, df_0, ...). tokens: a column of words; None counts the words of
    ``text`` where they stand. set_tf: a repeated word counts once. Null texts
    have no words, repeated blocks count as often as they are there, an empty
    table gives an empty result, and blocks may have columns of any names (a
    column ``score`` is replaced). The counts are generated columns, made
    once a row; statistics are one row and are joined back to every block.
    """
    terms = keywords(e)
    if len(terms) > MOST_KEYWORDS:
        raise ValueError(f"a query may have {MOST_KEYWORDS} keywords")
    only_excludes = all(t.excluded for t in leaves(e))
    exact = {k for t in leaves(e) if t.exact for k in t.keywords}
    row = blocks.select(F.struct("*").alias("row"), *([F.col(text).alias("text")] if text else []), *([F.col(tokens).alias("bag")] if tokens else []))  # so that no name clashes
    if tokens:
        bag = F.array_distinct("bag") if set_tf else F.col("bag")
        written = {k for t in leaves(e) if t.excluded for k in t.keywords} if text else set()  # these aren't analysed, so the text has them as they are
        counts = [F.coalesce(F.array_size(bag), F.lit(0)).cast("double").alias("dl"), *[(analyzer.count_word(F.col("text"), t) if t in written else occurrences(F.coalesce(bag, F.array()), t)).cast("double").alias(f"tf_{i}") for i, t in enumerate(terms)]]
    else:
        if not only_excludes and not corpus_wide:
            row = row.where(some_of([F.lower("text").contains(t) for t in terms]))
        counts = [analyzer.count_words(F.col("text")).cast("double").alias("dl"), *[analyzer.count_word(F.col("text"), t).cast("double").alias(f"tf_{i}") for i, t in enumerate(terms)]]
    raw = row.select("row", F.inline(F.array(F.struct(*counts, *[F.coalesce(F.lower("text").contains(k), F.lit(False)).alias(f"in_{i}") for i, k in enumerate(terms) if text and k in exact]))))

    def has(k: str, exact: bool) -> Column:
        return F.col(f"in_{terms.index(k)}") if exact and text else F.col(f"tf_{terms.index(k)}") > 0

    some = compile_match(e, has)
    any_hit = F.lit(only_excludes) | some_of([F.col(f"tf_{i}") > 0 for i in range(len(terms))])
    candidates = raw if corpus_wide else raw.where(any_hit)
    counted = candidates.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), *[F.count(F.when(F.col(f"tf_{i}") > 0, 1)).cast("double").alias(f"df_{i}") for i in range(len(terms))])
    joined = raw.where(any_hit & some)
    joined = joined.crossJoin(F.broadcast(counted)) if stats is None else joined.withColumns({k: F.lit(float(v)) for k, v in stats.items()})  # one row

    def score(k: str) -> Column:
        i = terms.index(k)
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    return joined.withColumn("score", compile_score(e, score)).select(*[F.col("row")[c].alias(c) for c in blocks.columns if c != "score"], "score")


def some_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


# The factor of each kind of node.
BOOSTS = {
    2.0: "function_item function_declaration method_declaration function_definition function_expression arrow_function method_definition method singleton_method constructor_declaration",
    1.8: "impl_item struct_item class_declaration type_definition interface_declaration class_specifier struct_specifier struct_declaration interface_type protocol_declaration type_alias_declaration typealias_declaration",
    1.6: "enum_item trait_item enum_declaration enum_specifier type_declaration type_spec trait_declaration extension_declaration delegate_declaration",
    1.4: "module mod_item namespace namespace_declaration namespace_definition module_declaration package_declaration",
    1.3: "property_declaration event_declaration const_declaration var_declaration variable_declaration constant_declaration const_spec var_spec",
    1.1: "export_statement declare_statement declaration",
    0.5: "line_comment comment // /* */",
}
#: Comments of more lines than this above their first are documentation, with a factor of their own.
DOC_LINES, DOC_BOOST, TEST_BOOST = 3, 1.2, 0.7


def boost(kind: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """The factor of a kind of node. Long documentation is told by its lines, tests by their name; other kinds have 1."""
    out = F.when(kind.contains("test") | kind.contains("Test"), TEST_BOOST).otherwise(1.0)
    out = F.when(kind.isin(*BOOSTS[0.5].split()), 0.5).otherwise(out)
    for factor, kinds in BOOSTS.items():
        if factor != 0.5:
            out = F.when(kind.isin(*kinds.split()), factor).otherwise(out)
    if start is not None:
        out = F.when(kind.isin("doc_comment", "block_comment") & (end - start > DOC_LINES), DOC_BOOST).otherwise(out)
    return out


def top(scored: DataFrame, n: int, *ties: str, by: str = "score") -> DataFrame:
    """The n best with their rank from 1; ties are in the order of the columns given."""
    best = scored.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), *ties)))


#: A file is taken to be this much longer than its last hit.
MORE_LINES = 100


def match_stats(tokens: Column, terms: list[str]) -> list[Column]:
    """The query's terms that a block has, sorted, and their number; both counters of matches are that number."""
    there = F.array_sort(F.array_intersect(F.array(*map(F.lit, sorted(set(terms)))), tokens))
    return [there.alias("matched_keywords"), F.size(there).alias("block_unique_terms"), F.size(there).alias("block_total_matches")]


#: What the idf of a term in a file's name counts for.
NAME_BOOST = 2.0


def early_scores(hits: DataFrame, n_terms: int, named: DataFrame | None = None) -> DataFrame:
    """hits(path, term, tf, dl), a row for each path and term at most -> (path, score).

    The sum of idf by saturated tf, raised with the share of the query's terms.
    named(path, term): terms in the names of files; each adds its idf doubled.
    N and the mean length are over paths with a hit; df of a term without hits is 1.
    """
    rows = hits.select("path", "term", "tf", "dl", F.lit(False).alias("name"))
    if named is not None:
        rows = rows.unionByName(named.select("path", "term", F.lit(None).alias("tf"), F.lit(None).alias("dl"), F.lit(True).alias("name")))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    all_of = hits.groupBy("path").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    w = rows.join(F.broadcast(df), "term", "left").crossJoin(F.broadcast(all_of))  # a row for each term of the query, and one row
    idf = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(1)) + 1))
    part = idf * F.col("tf") * (EARLY_K1 + 1) / (F.col("tf") + EARLY_K1 * (1 - EARLY_B + EARLY_B * F.col("dl") / F.col("avgdl")))
    part = F.when(F.col("name"), NAME_BOOST * idf).otherwise(part)
    return w.groupBy("path").agg(F.sum(part).alias("s"), F.count("*").alias("c")).select("path", (F.col("s") * (1 + 0.5 * F.col("c") / n_terms)).alias("score"))


#: Fixed values of the estimate of how many files a search has to look at.
FILES_LEAST, RESULTS_A_FILE, ROOM, RESULTS_DEFAULT, TOKENS_A_RESULT = 20, 2.5, 1.5, 1000, 250


def files_needed(max_results: int | None = None, max_tokens: int | None = None, tokens_a_result: int = TOKENS_A_RESULT) -> int:
    """How many of the files with the best early scores give enough results, with room to spare."""

    def files(results: int) -> int:
        return math.ceil(math.ceil(results * ROOM) / RESULTS_A_FILE)

    n = files(RESULTS_DEFAULT if max_results is None else max_results)
    if max_tokens is not None:
        n = min(n, files(max_tokens // max(1, tokens_a_result)))
    return max(FILES_LEAST, n)


#: Rows that a scorer gets at most, and tokens of a batch (its rows times its longest text, by TOKEN_BYTES bytes a token).
RERANKED, BATCH_TOKENS, TOKEN_BYTES = 100, 8192, 4


def batches_of(lengths: list[int], most: int) -> list[list[int]]:
    """Places in the order of lengths, cut into batches whose number times the longest is ``most`` at most; what is longer alone is a batch."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and (len(out[-1]) + 1) * lengths[i] <= most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def rescored(ranked: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], k: int = RERANKED, path: str = "path", code: str = "code", most: int = BATCH_TOKENS, tasks: int = 8) -> DataFrame:
    """ranked (with ``rank``) with its k best in the order of a scorer, and the rest after them as before; ``score`` is the scorer's there.

    scorer(query, texts) gives a number for each text, higher ones first; it is
    sent to the tasks and gets batches of texts of similar length, bounded in
    tokens. A text is headed by its file's name (ranking_text). Rows that tie
    stay in their order, null texts are empty, and a scorer that gives nan for
    a text puts it last.
    """
    text = ranking_text(F.coalesce(F.col(path), F.lit("")), F.coalesce(F.col(code), F.lit("")))
    best = ranked.where(F.col("rank") <= k).select(F.struct("*").alias("row"), F.col("rank").alias("was"), text.alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            out: list[float] = [0.0] * len(texts)
            for some in batches_of([len(t.encode("utf-8", "surrogatepass")) // TOKEN_BYTES + 1 for t in texts], most):
                for i, x in zip(some, scorer(query, [texts[j] for j in some]), strict=True):
                    out[i] = float(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["place", "new"])

    new = best.select("was", "text").repartition(min(tasks, max(1, k)), "was").mapInArrow(run, "place int, new double")
    order = Window.orderBy(F.when(F.isnan("new"), None).otherwise(F.col("new")).desc_nulls_last(), "was")  # k rows
    first = best.join(new, F.col("was") == F.col("place")).withColumn("now", F.row_number().over(order))
    shown = [F.col("now").alias("rank") if c == "rank" else F.col("new").alias("score") if c == "score" else F.col("row")[c].alias(c) for c in ranked.columns]
    rest = ranked.where(F.coalesce(F.col("rank") > k, F.lit(True)))
    return first.select(shown).unionByName(rest).orderBy(F.col("rank").asc_nulls_last())


def ranking_text(path: Column, code: Column) -> Column:
    """A block as a scorer that reads text gets it: headed by its file's name."""
    return F.concat(F.lit("// Filename: "), path, F.lit("\n"), code)


def rerank(vectors: DataFrame, query: list[float], n: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Order by the dot product with a query's vector: the hook for a stronger scorer."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector_col, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, x: t + x)
    return top(vectors.select(id_col, dot.alias("score")), n, id_col)
