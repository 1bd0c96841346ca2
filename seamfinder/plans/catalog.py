"""The registered queries over the driver's tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analyzer, compounds, tokens
from ..functions.lexicon import CODE_STOP_WORDS, STOP_WORDS
from ..operators import blocks, pattern, rank, search, spans, targets
from ..sources import corpus, scratch, sinks
from .query import compile_match, parse

QUERIES: dict = {}
ORACLE_SQL: dict = {}

# SQL that queries share
WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
FILES = f"files as (select doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/doc_' || coalesce(doc_id::varchar, '-') || '.txt' as path, coalesce(text, '') as content, {WORDS.format("coalesce(text, '')")} as ws from documents where strlen(coalesce(text, '')) <= 1048576)"
LINES = "raw_lines as (select doc_id, path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no from files)"
TERMS = ("the", "scum", "thre")


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents_as_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _round(c) -> F.Column:
    return F.round(c, 6)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(files_of(spark, sf_dir), '+the (thre OR token) -scum', 10)


# scans and projections


@query(f"with {FILES}, {LINES} select path, line_no::int as line_no, case when strlen(line) > 500 then '' else line end as line from raw_lines")
def scan_lines(spark, d):
    return corpus.lines(files_of(spark, d)).select("path", "line_no", corpus.shown(F.col("line")).alias("line"))


@query("select doc_id, source from documents where lang in ('en', 'de') and source in ('src1', 'src2')")
def filter_lang_source(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where(F.col("lang").isin("en", "de") & F.col("source").isin("src1", "src2")).select("doc_id", "source")


# Names that globs are tried on.
NAMES = (
    "src/main.rs node_modules/a/x.js vendor/x.go target/y.rs dist/a.js build/a.c .git/HEAD .svn/x .hg/x .idea/a.xml .vscode/s.txt __pycache__/m.py m.pyc m.pyo A.class a.o a.obj a.a a.lib a.so a.dylib a.dll a.exe a.out x.app/y a.jar a.war a.ear a.zip "
    "a.tar.gz a.rar a.log a.tmp a.temp a.swp a.swo a.bak a.orig .DS_Store Thumbs.db ci.yml ci.yaml package.json a.tconf nginx.conf lib/go.sum targets/a.rs distant.js builder/a.py a.jsonl go.summary a_test.rs a_tests.rs test_a.rs tests.rs a.spec.js a.test.js "
    "a.spec.ts a.test.ts a.spec.jsx a.test.jsx a.spec.tsx a.test.tsx test_a.py a_test.go test_a.c a_test.c a_test.cpp a_test.cc a_test.cxx FooTest.java a_test.rb test_a.rb a_spec.rb FooTest.php test_a.php tests/a.rs x/test/a.rs __tests__/a.js __test__/a.js spec/a.rb specs/a.rb "
    "attest.rs latest/a.rs contest.go a_test.py respec/a.js _underscore/a.rs"
).split()
_PATHS = "'p' || doc_id || '/' || element_at(split('{0}', ' '), cast(doc_id % {1} as int) + 1)".format(" ".join(NAMES), len(NAMES))
_SQL_PATHS = "'p' || doc_id || '/' || (string_split('{0}', ' '))[doc_id % {1} + 1]".format(" ".join(NAMES), len(NAMES))
_any_glob = lambda globs: " or ".join(f"c glob '{g}'" for g in globs)


@query(f"select doc_id, path from (select doc_id, {_SQL_PATHS} as path from documents) where len(list_filter(string_split(path, '/'), lambda c: {_any_glob(corpus.IGNORED)})) = 0")
def path_ignore_globs(spark, d):
    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(_PATHS).alias("path"))
    return df.where(~corpus.ignored(F.col("path")))


@query(f"""select doc_id, path, regexp_matches(path, '(?i)(^|/)(tests?|__tests__|specs?)/|(^|/)test_[^/]*$|_(test|spec)\\.[^./]+$|\\.(test|spec)\\.[^./]+$') as is_test from (select doc_id, {_SQL_PATHS} as path from documents)
where len(list_filter(string_split(path, '/'), lambda c: {_any_glob(corpus.IGNORED + corpus.TEST_FILES + ('p7',))})) = 0 and len(list_filter(string_split(path, '/')[:-2], lambda c: c in ('tests', 'test', '__tests__', '__test__', 'spec', 'specs'))) = 0""")
def path_test_globs(spark, d):
    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(_PATHS).alias("path"))
    return df.where(~corpus.ignored(F.col("path"), more=("p7",), tests=False)).withColumn("is_test", corpus.is_test(F.col("path")))


@query(f"with {FILES}, {LINES} select path, line_no::int as line_no, term from raw_lines, (select unnest(['the', 'scum', 'thre']) as term) where strlen(line) <= 2000 and contains(lower(line), term)")
def line_match_terms(spark, d):
    return search.line_hits(files_of(spark, d), list(TERMS))


@query(f"with {FILES}, {LINES} select path, term, count(*) as n_lines, min(line_no)::int as first_line, max(line_no)::int as last_line from raw_lines, (select unnest(['the', 'scum', 'thre']) as term) where strlen(line) <= 2000 and contains(lower(line), term) group by 1, 2")
def lines_by_term(spark, d):
    return search.line_hits(files_of(spark, d), list(TERMS)).groupBy("path", "term").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query(f"with {FILES}, {LINES} select path, line_no::int as line_no, i::int as term from raw_lines, (values (0, 'idiot'), (1, 'scum'), (2, 'stupid')) t(i, word) where strlen(line) <= 2000 and contains(lower(line), word)")
def pattern_lines(spark, d):
    """Lines with a query's words or stems, by one automaton; the words of the query are not those of the texts."""
    return pattern.line_terms(files_of(spark, d), parse("Scum idiots stupidity", analyzer.tokenize))


# boolean families


def _match(name: str, text: str, where: str, files_level: bool = False):
    def run(spark, d):
        return search.file_filter(files_of(spark, d), text, files_level).select("path")

    run.__name__ = name
    query(f"with {FILES} select path from files where {where}")(run)


_h = lambda w: f"list_contains(ws, '{w}')"
_match("match_and", "the AND thre", f"{_h('the')} and {_h('thre')}")
_match("match_or", "thre der", f"{_h('thre')} or {_h('der')}")
_match("match_required_optional", "+the thre token", _h("the"))
_match("match_excluded", "the -scum", f"{_h('the')} and not {_h('scum')}")
_match("match_only_excluded", "-the", f"not {_h('the')}")
_match("match_nested", "(thre OR tion) AND (the OR der) -scum", f"({_h('thre')} or {_h('tion')}) and ({_h('the')} or {_h('der')}) and not {_h('scum')}")
_match("match_left_to_right", "thre der AND the", f"({_h('thre')} or {_h('der')}) and {_h('the')}")
_match("match_exact_phrase", '"of the"', "contains(lower(content), 'of the')")
_match("match_parts", "the_thre", f"{_h('the')} and {_h('thre')}")
_match("match_file_level", "the -scum", f"{_h('the')}", True)
_match("match_empty", "qqqq AND zzzz", "false")


@query("select conv_id, turn from conversations where list_contains(" + WORDS.format("text") + ", 'the') and not list_contains(" + WORDS.format("text") + ", 'of')")
def match_conversations(spark, d):
    e = parse("the -of", search.plain)
    t = analyzer.terms(F.col("text"))
    return spark.read.parquet(f"{d}/conversations.parquet").where(compile_match(e, lambda k, _: F.array_contains(t, k))).select("conv_id", "turn")


@query(f"with {FILES} select path, 'file' as node_type, 1 as start, 1 as \"end\" from files where {_h('thre')}")
def files_only(spark, d):
    return search.file_filter(files_of(spark, d), "thre").select("path", F.lit("file").alias("node_type"), F.lit(1).alias("start"), F.lit(1).alias("end")).distinct()


@query(f"with {FILES} select path from files where not {_h('en')} and len(list_filter({WORDS.format('path')}, lambda w: contains(w, 'en') or contains('en', w))) > 0")
def match_filename(spark, d):
    f = files_of(spark, d)
    by_content = f.where(analyzer.has_word(F.col("content"), "en")).select("path")
    named = f.where(F.exists(analyzer.terms(F.col("path")), lambda w: w.contains("en") | F.lit("en").contains(w)))
    return named.join(by_content, "path", "left_anti").select("path")


# statistics and ranking

BAG = f"{FILES}, w as (select path, unnest(ws) as term from files)"


@query(f"with {BAG} select term, count(distinct path) as df from w group by term")
def doc_frequency(spark, d):
    w = files_of(spark, d).select("path", F.explode(analyzer.terms(F.col("content"))).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("df"))


@query(f"with {BAG} select path, term, count(*) as tf from w group by 1, 2")
def term_frequency(spark, d):
    w = files_of(spark, d).select("path", F.explode(analyzer.words(F.col("content"))).alias("term"))
    return w.groupBy("path", "term").agg(F.count("*").alias("tf"))


@query(f"with {FILES} select round(avg(len(ws)), 6) as avgdl, count(*) as n from files")
def avg_doc_length(spark, d):
    return files_of(spark, d).agg(_round(F.avg(F.size(analyzer.words(F.col("content"))))).alias("avgdl"), F.count("*").alias("n"))


_EDGED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"


@query(f"""with {FILES}, w as (select unnest({WORDS.format(_EDGED)}) as word from files) select word, count(*) as n from w where regexp_full_match(word, '[a-z]{{3,24}}') and word not in ({", ".join(f"'{w}'" for w in sorted(STOP_WORDS | CODE_STOP_WORDS))}) group by 1 having count(*) >= 2 order by n desc, word limit 200000""")
def word_counts(spark, d):
    """The words by which compounds are divided."""
    return compounds.counted(files_of(spark, d))


@query()
def compound_parts(spark, d):
    """Every word of the documents with its parts, by the documents' own counts."""
    counts = scratch.kept(compounds.word_counts(files_of(spark, d)), "words")
    return compounds.divided(counts.select("word"), compounds.Lattice.by(counts)).where(F.size("parts") > 1)


@query(f"with {BAG}, n as (select count(*) as n from files) select term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from (select term, count(distinct path) as df from w group by term), n")
def idf(spark, d):
    df = doc_frequency(spark, d)
    n = files_of(spark, d).agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", _round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))


EARLY = f"""with {FILES}, {LINES}, l as (select path, line_no, term from raw_lines, (select unnest(['the', 'scum', 'thre']) as term) where strlen(line) <= 2000 and contains(lower(line), term)),
hits as (select path, term, count(*) as tf, max(max(line_no)) over (partition by path) + 100 as dl from l group by 1, 2), d as (select term, count(*) as df from hits group by 1), a as (select count(*) as n, avg(dl) as avgdl from (select distinct path, dl from hits)),
parts as (select path, ln((n + 1) / (df + 1)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) as part from hits join d using (term), a
union all select path, 2.0 * ln((n + 1) / (coalesce(df, 1) + 1)) from files, (select unnest(['the', 'scum', 'thre']) as term) left join d using (term), a where contains(lower(path), term)),
s as (select path, round(sum(part) * (1 + 0.5 * count(*) / 3), 6) as score from parts group by path)"""


def _early(spark, d):
    f = files_of(spark, d)
    l = search.line_hits(f, list(TERMS)).groupBy("path", "term").agg(F.count("*").alias("tf"), F.max("line_no").alias("last"))
    hits = l.withColumn("dl", F.max("last").over(Window.partitionBy("path")) + rank.MORE_LINES).drop("last")
    named = f.select("path", F.explode(F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.lower("path").contains(t))).alias("term"))
    return rank.early_scores(hits, 3, named).select("path", _round("score").alias("score"))


@query(EARLY + " select path, score from s")
def early_score(spark, d):
    return _early(spark, d)


@query(EARLY + " select path, score, row_number() over (order by score desc, path)::int as rank from s order by score desc, path limit 24")
def early_files(spark, d):
    """The files that a search for 40 results looks at."""
    return rank.top(_early(spark, d), rank.files_needed(40), "path")


@query(f"with {FILES} select path, list_sort(list_filter(['the', 'scum', 'thre'], lambda t: list_contains(ws, t))) as matched_keywords, len(list_filter(['the', 'scum', 'thre'], lambda t: list_contains(ws, t)))::int as block_unique_terms, len(list_filter(['the', 'scum', 'thre'], lambda t: list_contains(ws, t)))::int as block_total_matches from files")
def match_stats(spark, d):
    return files_of(spark, d).select("path", *rank.match_stats(analyzer.words(F.col("content")), list(TERMS)))


def _bm25_sql(where: str, cols: list[str], score: str, bag: str = "ws", any_of: str | None = None, more: str = "") -> str:
    tf = ", ".join(f"len(list_filter({bag}, lambda x: x = '{c}'))::double as tf{i}" for i, c in enumerate(cols))
    some = any_of or " or ".join(f"tf{i} > 0" for i in range(len(cols)))
    dfs = ", ".join(f"count(*) filter (tf{i} > 0)::double as df{i}" for i in range(len(cols)))
    s = ", ".join(f"case when tf{i} > 0 then ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.5 + 0.5 * dl / avgdl)) else 0 end as s{i}" for i in range(len(cols)))
    return f"with {FILES}, b as (select path, content, len({bag})::double as dl, {tf} from files), c as (select * from b where {some}), st as (select count(*)::double as n, avg(dl) as avgdl, {dfs} from c), s as (select path, content, {s} from c, st where {where}) select path, round({score}, 6) as score from s{more}"


def _bm25(name: str, text: str, sql: str, set_tf: bool = False):
    def run(spark, d):
        f = files_of(spark, d)
        f = f.withColumn("tokens", analyzer.words(F.col("content"))) if set_tf else f
        return rank.bm25(f, parse(text, search.plain), "tokens" if set_tf else None, text="content", set_tf=set_tf).select("path", _round("score").alias("score"))

    run.__name__ = name
    query(sql)(run)


_bm25("bm25_should", "thre der", _bm25_sql("true", ["der", "thre"], "s0 + s1"))
_bm25("bm25_must", "+thre the", _bm25_sql("tf1 > 0", ["the", "thre"], "s0 + s1"))
_bm25("bm25_must_not", "the -scum", _bm25_sql("tf1 > 0 and tf0 = 0", ["scum", "the"], "s1"))
_bm25("bm25_set_tf", "thre der", _bm25_sql("true", ["der", "thre"], "s0 + s1", "list_distinct(ws)"), True)


@query("with s as (" + _bm25_sql("true", ["der", "thre"], "s0 + s1") + ") select path, score, row_number() over (order by score desc, path)::int as rank from s order by score desc, path limit 25")
def ranked_top(spark, d):
    s = rank.bm25(files_of(spark, d), parse("thre der", search.plain), None, text="content").select("path", _round("score").alias("score"))
    return rank.top(s, 25, "path")


_LINE_KIND = """case when regexp_matches(t, '^(//|/\\*|\\*|#|--)') then 'comment' when regexp_matches(t, '^((pub |async |static )*(fn|func|function|def) )') then 'function' when regexp_matches(t, '^((pub )?(class|struct|enum|trait|interface|impl) )') then 'class'
 when regexp_matches(t, '^((import|use|from|include|require) )') then 'import' when regexp_matches(t, '^((let|const|var) )') then 'variable_declaration' when regexp_matches(t, '^((if|for|while|switch|match|else|return)\\b)') then 'control_flow' else 'code' end"""


@query(f"with {FILES}, {LINES}, k as (select path, line_no, {_LINE_KIND} as node_type from (select *, lower(trim(line, ' ')) as t from raw_lines)) select path, line_no::int as line_no, node_type from k where node_type <> 'code'")
def node_type_fallback(spark, d):
    return corpus.lines(files_of(spark, d)).select("path", "line_no", corpus.node_type(F.col("line")).alias("node_type")).where("node_type <> 'code'")


@query(f"with {FILES}, {LINES}, k as (select path, line_no, {_LINE_KIND} as node_type from (select *, lower(trim(line, ' ')) as t from raw_lines)) select node_type, count(*) as n, round(sum((case when node_type = 'variable_declaration' then 1.3 when node_type = 'comment' then 0.5 else 1.0 end)::double), 6) as boosted from k group by 1")
def boosted_rank(spark, d):
    k = corpus.lines(files_of(spark, d)).select(corpus.node_type(F.col("line")).alias("node_type"))
    return k.groupBy("node_type").agg(F.count("*").alias("n"), _round(F.sum(rank.boost(F.col("node_type")))).alias("boosted"))


# line ranges

HITS = f"{FILES}, {LINES}, hits as (select distinct path, line_no from raw_lines where strlen(line) <= 2000 and contains(lower(line), 'scum')), len as (select path, len(string_split(content, chr(10))) as n_lines from files)"
ISLANDS = "m as (select path, start, \"end\", sum(new) over (partition by path order by start, \"end\") as island from (select *, case when before is null or start > before + 1 + apart then 1 else 0 end as new from (select *, max(\"end\") over (partition by path order by start, \"end\" rows between unbounded preceding and 1 preceding) as before from r)))"


def _hit_lines(spark, d):
    f = files_of(spark, d)
    return f, search.line_hits(f, ["scum"]).select("path", "line_no")


@query(f"with {HITS}, r as (select path, greatest(1, line_no - 5) as start, least(n_lines, line_no + 5) as \"end\", case when count(*) over (partition by path) > 10 then 8 when count(*) over (partition by path) > 5 then 6 else 1 end as apart from hits join len using (path)), {ISLANDS} select path, min(start)::int as start, max(\"end\")::int as \"end\", count(*) as parts from m group by path, island")
def context_windows(spark, d):
    f, hits = _hit_lines(spark, d)
    return spans.context_windows(hits, f.select("path", F.size(F.split("content", "\n")).alias("n_lines")))


R0 = "r0 as (select path, (x * 7 % 40 + 1) as start, (x * 7 % 40 + 1 + x % 5) as \"end\", x from (select path, doc_id, unnest(range(1, 4 + doc_id % 9)) as x from files))"
RANGES = f"{FILES}, {R0}"


def _ranges(spark, d):
    x = files_of(spark, d).select("path", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 9 + 3).cast("int"))).alias("x"))
    return x.select("path", (F.col("x") * 7 % 40 + 1).alias("start"), (F.col("x") * 7 % 40 + 1 + F.col("x") % 5).alias("end"), "x")


@query(f"with {RANGES}, r as (select *, 5 as apart from r0), {ISLANDS} select path, min(start)::int as start, max(\"end\")::int as \"end\", count(*) as parts from m group by path, island")
def merge_blocks(spark, d):
    return spans.merge(_ranges(spark, d), "path", 5)


@query(f"with {RANGES}, r as (select *, 5 as apart from r0), m as (select path, start, \"end\", x, sum(new) over (partition by path order by start, \"end\") as island from (select *, case when before is null or start > before + 1 + apart then 1 else 0 end as new from (select *, max(\"end\") over (partition by path order by start, \"end\" rows between unbounded preceding and 1 preceding) as before from r))) select path, min(start)::int as start, max(\"end\")::int as \"end\", count(*) as parts, max(x)::int as best, sum(x)::bigint as total from m group by path, island")
def merge_stats(spark, d):
    return spans.merge(_ranges(spark, d), "path", 5, best=F.max("x"), total=F.sum("x"))


@query(f"with {HITS}, r as (select path, greatest(1, line_no - 5) as start, least(n_lines, line_no + 5) as \"end\", 1 as apart from hits join len using (path)), {ISLANDS}, g as (select path, min(start)::int as start, max(\"end\")::int as \"end\" from m group by path, island) select g.path, g.start, g.\"end\", string_agg(case when strlen(line) > 500 then '' else line end, chr(10) order by line_no) as code from g join raw_lines l on l.path = g.path and l.line_no between g.start and g.\"end\" group by 1, 2, 3")
def merge_gap_fill(spark, d):
    f, hits = _hit_lines(spark, d)
    n = f.select("path", F.size(F.split("content", "\n")).alias("n"))
    wide = hits.join(n, "path").select("path", F.greatest(F.lit(1), F.col("line_no") - 5).alias("start"), F.least("n", F.col("line_no") + 5).alias("end"))
    return spans.block_text(spans.merge(wide, "path", 1), corpus.lines(f).withColumn("line", corpus.shown(F.col("line"))))


@query(f"with {RANGES}, u as (select distinct path, start, \"end\" from r0) select path, start::int as start, \"end\"::int as \"end\" from u a where not exists (select 1 from u b where b.path = a.path and b.start <= a.start and b.\"end\" >= a.\"end\" and (b.start <> a.start or b.\"end\" <> a.\"end\"))")
def containment_dedup(spark, d):
    return spans.contained(_ranges(spark, d).select("path", "start", "end"))


_LIMIT = f"with {FILES}, b as (select path, strlen(content) as bytes, greatest(1, strlen(content) // 4) as tokens from files), t as (select *, row_number() over w as rank, sum(bytes) over w as run_bytes, sum(tokens) over w as run_tokens from b window w as (order by bytes, path rows between unbounded preceding and current row)) "


def _sized(spark, d):
    return files_of(spark, d).select("path", F.col("size").alias("bytes"), F.greatest(F.lit(1), F.floor(F.col("size") / 4)).alias("tokens"))


@query(_LIMIT + "select path, rank::int as rank from t where rank <= 50")
def limit_results(spark, d):
    return spans.limited(_sized(spark, d), ["bytes", "path"], max_results=50).select("path", "rank")


@query(_LIMIT + "select path, run_bytes::bigint as run_bytes from t where run_bytes <= 30000")
def limit_bytes(spark, d):
    return spans.limited(_sized(spark, d), ["bytes", "path"], max_bytes=30000).select("path", "run_bytes")


@query(_LIMIT + "select path, run_tokens::bigint as run_tokens from t where run_tokens <= 9000")
def limit_tokens_estimate(spark, d):
    return spans.limited(_sized(spark, d), ["bytes", "path"], max_tokens=9000).select("path", "run_tokens")


@query()
def limit_tokens_exact(spark, d):
    """The files that come to 9000 tokens, the shortest first, by exact counts of no more files than it takes."""
    import public_tokenizers

    count = tokens.byte_pairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return spans.limited_tokens(files_of(spark, d).select("path", "size", "content"), ["size", "path"], 9000, count, "content").select("path", "rank", "run_tokens")


@query(_LIMIT + "select path from t where run_bytes > 30000")
def skipped_rows(spark, d):
    return spans.limited(_sized(spark, d), ["bytes", "path"], max_bytes=30000, skipped=True).select("path")


@query(f"with {HITS}, {R0} select path, line_no::int as line_no from hits h where not exists (select 1 from r0 where r0.path = h.path and h.line_no between r0.start and r0.\"end\")")
def session_antijoin_lines(spark, d):
    return spans.unseen_lines(_hit_lines(spark, d)[1], _ranges(spark, d))


@query(f"with {RANGES} select path, start::int as start, \"end\"::int as \"end\" from r0 a where not exists (select 1 from r0 b where b.x % 2 = 0 and b.path = a.path and b.start = a.start and b.\"end\" = a.\"end\")")
def session_antijoin_blocks(spark, d):
    r = _ranges(spark, d)
    return spans.unseen_blocks(r.select("path", "start", "end"), r.where("x % 2 = 0"))


# extraction

#: What each turn of a conversation says here, with places of four families, marks, a place on the net, code and abbreviations.
_TALK = "'see **' || role || '/mod_' || turn || '.rs:' || (conv_id % 90 + 1) || '-' || (conv_id % 90 + 9) || '** and ~~lib/x.py#Parent.child~~, self.value, e.g. `src/a' || (conv_id % 7) || '.go:7:3` (data.length or list.map) \"main.c:12\", main.c, it''s in README.md or https://a.com/b' || turn || '.html:9, ``tests/t.js`` and \"src/{a,b}*.ts\"'"


@query(f"""select conv_id, turn, v.* from conversations, lateral (values
  (role || '/mod_' || turn || '.rs:' || (conv_id % 90 + 1) || '-' || (conv_id % 90 + 9), role || '/mod_' || turn || '.rs', (conv_id % 90 + 1)::int, (conv_id % 90 + 9)::int, null::varchar), ('lib/x.py#Parent.child', 'lib/x.py', null, null, 'Parent.child'),
  ('src/a' || (conv_id % 7) || '.go:7:3', 'src/a' || (conv_id % 7) || '.go', 7, 7, null), ('main.c:12', 'main.c', 12, 12, null), ('README.md', 'README.md', null, null, null), ('tests/t.js', 'tests/t.js', null, null, null), ('src/{{a,b}}*.ts', 'src/{{a,b}}*.ts', null, null, null)) v(target, path, start, "end", symbol) where role is not null and turn is not null and conv_id is not null""")
def extract_targets_from_text(spark, d):
    return targets.targets(spark.read.parquet(f"{d}/conversations.parquet").withColumn("t", F.expr(_TALK.replace("''s", "\\'s"))), "t", "conv_id", "turn")


@query(f"""with {FILES}, g(target) as (values ('src1/*/doc_1?.txt'), ('src*/en/doc_{{7,8}}*.txt'), ('src2/**'), ('**/doc_33.txt'), ('no/such.txt'), ('none/*.txt'))
select target, coalesce(files.path, target) as path from g left join files on case target when 'src1/*/doc_1?.txt' then regexp_full_match(path, 'src1/[a-z-]*/doc_1.\\.txt') when 'src*/en/doc_{{7,8}}*.txt' then regexp_full_match(path, 'src[0-9]*/en/doc_[78][0-9]*\\.txt')
 when 'src2/**' then starts_with(path, 'src2/') when '**/doc_33.txt' then ends_with(path, '/doc_33.txt') else false end where files.path is not null or target = 'no/such.txt'""")
def globs_expanded(spark, d):
    f = files_of(spark, d).select("path")
    found = spark.createDataFrame([(g, g) for g in ("src1/*/doc_1?.txt", "src*/en/doc_{7,8}*.txt", "src2/**", "**/doc_33.txt", "no/such.txt", "none/*.txt")], "target string, path string")
    return targets.expanded(found, f)


_DIFF = ["diff --git a/x.rs b/x.rs", "--- a/x.rs", "+++ b/x.rs", "@@ -1,3 +1,4 @@", " one", "+two", " three", "-four", "+five", "@@ -20,2 +21,3 @@ fn f()", " a", "+b", "diff --git a/y.py b/y.py", "--- a/y.py", "+++ b/y.py", "@@ -0,0 +1,2 @@", "+p", "+q"]


@query("select benchmark.item_id as diff_id, v.path, v.line_no from benchmark, (values ('x.rs', 2), ('x.rs', 4), ('x.rs', 22), ('y.py', 1), ('y.py', 2)) v(path, line_no)")
def diff_changed_lines(spark, d):
    text = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("diff_id"), F.posexplode(F.array(*map(F.lit, _DIFF))).alias("pos", "line"))
    return spans.diff_lines(text).select("diff_id", "path", F.col("line_no").cast("int").alias("line_no"))


@query("with c as (select md5(text) as h, any_value(greatest(1, strlen(text) // 4)) as tokens from documents group by 1) select doc_id, tokens::bigint as tokens from documents join c on md5(text) = h")
def token_count_dedup(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.md5("text").alias("h"))
    counted = docs.select("h", F.octet_length("text").alias("b")).groupBy("h").agg(F.first("b").alias("b")).select("h", F.greatest(F.lit(1), F.floor(F.col("b") / 4)).alias("tokens"))
    return docs.select("doc_id", "h").join(counted, "h").select("doc_id", "tokens")


# sinks


def _results(spark, d):
    return files_of(spark, d).select("doc_id", "path", F.lit(1).alias("start"), F.size(F.split("content", "\n")).alias("end"), F.col("content").alias("code"))


@query(f"with {FILES} select count(*) as count, sum(strlen(content))::bigint as total_bytes, sum(greatest(1, strlen(content) // 4))::bigint as total_tokens from files")
def output_summary(spark, d):
    return sinks.summary(_results(spark, d))


@query()
def json_rows(spark, d):
    return sinks.json_rows(_results(spark, d).drop("doc_id"))


@query(f"with {FILES} select '<result><file>' || path || '</file><lines>1-' || len(string_split(content, chr(10))) || '</lines><code><![CDATA[' || replace(content, ']]>', ']]]]><![CDATA[>') || ']]></code></result>' as xml from files")
def xml_rows(spark, d):
    return sinks.xml_rows(_results(spark, d))


@query(f"with {FILES} select '## ' || path || ':1-' || len(string_split(content, chr(10))) || chr(10) || '```' || chr(10) || content || chr(10) || '```' as markdown from files")
def markdown_rows(spark, d):
    return sinks.markdown_rows(_results(spark, d))


# the full analyzer, source blocks, patterns, reranking


@query()
def analyzer_full(spark, d):
    return files_of(spark, d).select("path", analyzer.full_terms(F.col("content")).alias("terms"))


#: Source texts by extension, and the blocks they hold, written down by hand: (start, end, kind, name, parent, is it a test).
SOURCES = [
    ("rs", """// keeps addresses
pub struct IpList {
    items: Vec<String>,
}

struct Unit;

impl Keep for IpList {
    /// is it there
    pub fn contains<'a>(&self, x: &'a str) -> bool
    {
        if x == "}" { return true; }
        self.items.iter().any(|i| { i == x })
    }
}

#[cfg(test)]
mod tests {
    #[test]
    fn check() {
        load_users("fn none() {");
    }
}
""", [(2, 4, "struct_item", "IpList", None, False), (6, 6, "struct_item", "Unit", None, False), (8, 15, "impl_item", "IpList", None, False), (10, 14, "function_item", "contains", "IpList", False), (18, 23, "mod_item", "tests", None, True), (20, 22, "function_item", "check", "tests", True)]),
    ("js", """import x from 'y';

// loads users
async function loadUsers(db) {
  const rows = await db.query('select {');
  for (let i = 0; i < 3; i++) { x(i); }
  return rows;
}

const handler = (req, res) => {
  res.send(loadUsers(req.db));
};

class Store extends Base {
  constructor(x) { this.x = x; }
  async go(a, b) {
    later(function () { return 1; });
  }
}
""", [(4, 8, "function_declaration", "loadUsers", None, False), (10, 12, "arrow_function", "handler", None, False), (14, 19, "class_declaration", "Store", None, False), (15, 15, "method_definition", "constructor", "Store", False), (16, 18, "method_definition", "go", "Store", False)]),
    ("py", """class Loader:
    # reads a file
    def load(self, path):
        with open(path) as f:
            return f.read()

    def close(self):
        pass


@slow
def test_load():
    assert Loader().load('loadUsers')
""", [(1, 8, "class_definition", "Loader", None, False), (3, 5, "function_definition", "load", "Loader", False), (7, 8, "function_definition", "close", "Loader", False), (11, 13, "decorated_definition", None, None, True), (12, 13, "function_definition", "test_load", None, True)]),
    ("go", """package main

func main() {
\tprintln("ip {")
}

type Config struct {
\tName string
}

func (c *Config) Load(a int) (string, error) {
\treturn c.Name, nil
}

func TestLoad(t *testing.T) {
\ttype row struct {
\t\ta int
\t}
}
""", [(3, 5, "function_declaration", "main", None, False), (7, 9, "type_declaration", "Config", None, False), (11, 13, "method_declaration", "Load", None, False), (15, 19, "function_declaration", "TestLoad", None, True), (16, 18, "type_declaration", "row", "TestLoad", True)]),
    ("c", """#include <a.h>
#define OPEN {
int main(int a)
{
  if (a) { return 1; }
  return 0;
}

struct pair { int a; };
static char *name_of(void) {
  return 0;
}
""", [(3, 7, "function_definition", "main", None, False), (9, 9, "struct_specifier", "pair", None, False), (10, 12, "function_definition", "name_of", None, False)]),
    ("java", """package a;

public class Loader<T> extends Base {
  private int x;
  public Loader(int x) { this.x = x; }
  @Test
  public void load() throws E {
    for (int i = 0; i < 3; i++) { go(); }
  }
}
""", [(3, 10, "class_declaration", "Loader", None, False), (4, 4, "field_declaration", "x", "Loader", False), (5, 5, "constructor_declaration", "Loader", "Loader", False), (6, 9, "method_declaration", "load", "Loader", True)]),
    ("rb", """class Greeter
  def hello(name)
    if name
      puts name
    end
    [1].each do |x|
      p x
    end
  end

  def self.make
    loadUsers
  end
end
""", [(1, 14, "class", "Greeter", None, False), (2, 9, "method", "hello", "Greeter", False), (11, 13, "singleton_method", "make", "Greeter", False)]),
    ("md", """How to load users

Call loadUsers with a database.
""", []),
]
_quoted = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
_rows = lambda rows: ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
#: Every document stands for a source text, by turns, with up to three empty lines above it.
_SOURCE_SQL = f"""with texts(k, ext, content) as (values {_rows([(k, e, c) for k, (e, c, _) in enumerate(SOURCES)])}),
sources as (select 'src/m' || doc_id || '.' || ext as path, ext, k, (doc_id // {len(SOURCES)} % 4)::int as s, repeat(chr(10), (doc_id // {len(SOURCES)} % 4)::int) || content as content from documents join texts on doc_id % {len(SOURCES)} = k),
blocks(k, "start", "end", node_type, name, parent, is_test) as (values {_rows([(k, *b) for k, (_, _, bs) in enumerate(SOURCES) for b in bs])})"""
_SHIFTED = 'b."start"::int + s as "start", b."end"::int + s as "end"'
_CODE = """array_to_string((string_split(content, chr(10)))["start":"end"], chr(10)) as code"""


def sources_of(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.createDataFrame([(k, e, c) for k, (e, c, _) in enumerate(SOURCES)], "k long, ext string, text string")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") % len(SOURCES)).alias("k"))
    lines = (F.floor(F.col("doc_id") / len(SOURCES)) % 4).cast("int")
    return docs.join(F.broadcast(texts), "k").select(F.concat(F.lit("src/m"), F.col("doc_id"), F.lit("."), F.col("ext")).alias("path"), "ext", F.concat(F.expr("repeat('\n', cast(floor(doc_id / {}) % 4 as int))".format(len(SOURCES))), F.col("text")).alias("content"), lines.alias("s"))  # a text for each entry of SOURCES


def _wanted(spark, d, kinds: dict) -> DataFrame:
    """Targets by extension: (start, end, lines) in the unshifted text."""
    rows = spark.createDataFrame([(e, *v) for e, v in kinds.items()], "ext string, start int, end int, lines array<int>")
    moved = sources_of(spark, d).select("path", "ext", "s").join(F.broadcast(rows), "ext")  # as many as there are extensions
    return moved.select("path", (F.col("start") + F.col("s")).alias("start"), (F.col("end") + F.col("s")).alias("end"), F.transform("lines", lambda x: x + F.col("s")).alias("lines"))


def _extract_sql(pieces: list[tuple]) -> str:
    """pieces: (k, start, end, kind), the lines before they are moved; ends that say 'n' are the file's."""
    return _SOURCE_SQL + f""", pieces(k, lo, hi, node_type) as (values {_rows(pieces)}),
p as (select path, content, s, node_type, greatest(1, lo + case when node_type = 'file' then 0 else s end)::int as "start", least(len(string_split(content, chr(10))) - 1, hi + s)::int as "end" from sources join pieces using (k))
select path, "start", "end", node_type, {_CODE} from p"""


#: Texts made from units, by extension: header; what a unit has before its body, a line of the body, what it has after it; footer; the block around all (kind, name, first line of the header); the blocks of a unit (kind, name, first line, lines that are left below its end, parent, is it a test), names being followed by the unit's number. Each unit holds something that isn't what it looks like.
UNITS = [
    ("rs", "/* outer /* inner { */ still */\nimpl Keeper {\n", "    // unit\n    pub fn run_§(&self, x: &'static str) -> char {\n        let s = r#\"fn no() { \"#;\n", "        self.go('{', '\"');\n", "        fn deep_§() { }\n    }\n    #[test]\n    fn check_§() {}\n", "}\n", ("impl_item", "Keeper", 2), [("function_item", "run_", 2, 2, "Keeper", False), ("function_item", "deep_", -4, 3, "run_§", False), ("function_item", "check_", -1, 0, "Keeper", True)]),
    ("js", "import x from 'y';\nexport default class extends Base {\n", "  // unit\n  run_§(a, b) {\n    const q = a.replace(/[{/]/g, `t ${b ? `{${a}` : '}'} {`);\n", "    this.go(a / 2 / b, \"}\");\n", "  }\n  later_§ = async (e) => {\n    return { m_§(z) { return z; } };\n  }\n", "}\n", ("class_declaration", "default", 2), [("method_definition", "run_", 2, 3, "default", False), ("arrow_function", "later_", -3, 0, "default", False), ("method_definition", "m_", -2, 1, "later_§", False)]),
    ("ts", "import z from 'z';\nnamespace Units {\n", "  export interface Shape_§ { a: number; b: { c: string } }\n  export function test_§<T>(a: T): T {\n", "    call(() => { return a; });\n", "    return a;\n  }\n  type Either_§ = string | number;\n", "}\n", ("namespace_declaration", "Units", 2), [("interface_declaration", "Shape_", 1, None, "Units", False), ("function_declaration", "test_", 2, 1, "Units", True), ("type_alias_declaration", "Either_", -1, 0, "Units", False)]),
    ("py", "import x\nclass Units(Base):\n", "    \"\"\"def no():\n    class No: \"\"\"\n    @slow(\n        1)\n    def run_§(self, a=(\n1, 2)):\n", "        x = [1,\n2]  # def no2():\n", "        def deep_§(): pass\n", "other = 1\n", ("class_definition", "Units", 2), [("decorated_definition", None, 3, 0, "Units", False), ("function_definition", "run_", 5, 0, "Units", False), ("function_definition", "deep_", -1, 0, "run_§", False)]),
    ("go", "package units\n\nimport \"fmt\"\n", "// unit\nfunc (u *Unit) Run_§(a int) error {\n", "\tfmt.Println(`{ \" `, '{', \"}\")\n", "\ttype local_§ struct {\n\t\ta int\n\t}\n\treturn nil\n}\ntype Alias_§ int\nfunc Test_§(t *testing.T) {}\n", "", None, [("method_declaration", "Run_", 2, 2, None, False), ("type_declaration", "local_", -7, 4, "Run_§", False), ("type_declaration", "Alias_", -2, 1, None, False), ("function_declaration", "Test_", -1, 0, None, True)]),
    ("c", "#include <a.h>\n#define OPEN {\n", "#ifdef WIDE_§\nint run_§(int a, int b) {\n#else\nint run_§(int a) {\n#endif\n", "  if (a == '{') { go(\"}\\\"{\"); } /* { */\n", "  return 0;\n}\nstatic int count_§ = 0;\nenum kind_§ { ONE, TWO };\n", "", None, [("function_definition", "run_", 2, 2, None, False), ("declaration", "count_", -2, 1, None, False), ("enum_specifier", "kind_", -1, 0, None, False)]),
    ("cpp", "namespace a::units {\nclass Keeper final : public Base {\npublic:\n", "  // unit\n  int run_§(const char *x) const {\n    auto s = R\"x({ )\" )x\";\n", "    for (int i = 0; i < 1'000; ++i) { go('}'); }\n", "    return 0;\n  }\n  int field_§;\n", "};\n}\n", ("namespace_definition", "a::units", 1), [("function_definition", "run_", 2, 1, "Keeper", False)]),
    ("java", "package a;\npublic class Units<T> extends Base {\n", "  /** unit { */\n  @Test\n  public void run_§(int a) throws E {\n", "    go(\"\"\"\n  } \" {\n\"\"\");\n", "    Runnable r = new Runnable() {\n      public void inner_§() { }\n    };\n  }\n  private int field_§ = '}';\n", "}\n", ("class_declaration", "Units", 2), [("method_declaration", "run_", 2, 1, "Units", True), ("method_declaration", "inner_", -4, 3, "run_§", True), ("field_declaration", "field_", -1, 0, "Units", False)]),
    ("cs", "using System;\n#if A\nclass Units : Base {\n#else\nclass Units {\n#endif\n", "  // unit\n  public string Name_§ => $\"{{ {x[\"}\"]} {{\";\n  [Fact]\n  public int Run_§(int a) {\n", "    Go(@\"c:\\\"\"{\", '}');\n", "    return 0;\n  }\n  public int P_§ { get; set; }\n", "}\n", ("class_declaration", "Units", 3), [("property_declaration", "Name_", 2, None, "Units", False), ("method_declaration", "Run_", 3, 1, "Units", True), ("property_declaration", "P_", -1, 0, "Units", False)]),
    ("rb", "require 'x'\nclass Units < Base\n", "  # def no\n  def run_§(a)\n    text = <<~EOS\n      end\n      def no #{a}\n    EOS\n", "    a.each do |x|\n      y = if x =~ /end \\/ {/ then %w[end def] end\n    end\n", "  end\n  def self.make_§; end\n", "end\n", ("class", "Units", 2), [("method", "run_", 2, 1, "Units", False), ("singleton_method", "make_", -1, 0, "Units", False)]),
    ("php", "<b>{ function no() {</b>\n<?php\nclass Units {\n", "  // unit {\n  public function testRun_§(int $a): int {\n    $x = <<<EOT\n  } $a\nEOT;\n", "    if ($a) { go('{', \"}\"); } # }\n", "    return 0;\n  }\n  private function other_§() {}\n", "}\n?>\n<i>}</i>\n", ("class_declaration", "Units", 3), [("method_declaration", "testRun_", 2, 1, "Units", True), ("method_declaration", "other_", -1, 0, "Units", False)]),
    ("swift", "import X\nclass UnitsTests: XCTestCase {\n", "  /* a /* { */ } */\n  let limit_§ = 1\n  func run_§(a: Int)\n    -> Int {\n", "    go(\"\\(a + f(\"}\")) {\", { b in b })\n", "    let own = 2\n    return a\n  }\n", "}\n", ("class_declaration", "UnitsTests", 2), [("constant_declaration", "limit_", 2, None, "UnitsTests", True), ("function_declaration", "run_", 3, 0, "UnitsTests", True)]),
]
_height = lambda t: t.count("\n")


def _unit_rows() -> tuple[list, list]:
    """For each extension its heights, and its blocks: (k, kind, name, first line and last line of the unit without its body, lines from its top; whether either is below the body; parent, is_test)."""
    sizes, rows = [], []
    for k, (ext, head, pre, body, post, foot, _, units) in enumerate(UNITS):
        above, below = _height(pre), _height(post)
        sizes.append((k, ext, _height(head), above, _height(body), below, _height(foot)))
        for kind, name, first, left, parent, test in units:
            start = (above + below + first + 1, True) if first < 0 else (first, False)  # counted from the unit's end, or from its top
            end = start if left is None else (above + below - left, True)
            rows.append((k, kind, name, start[0], start[1], end[0], end[1], parent, test))
    return sizes, rows


_SIZES, _UNIT_BLOCKS = _unit_rows()
_AROUND = [(k, *u[6]) for k, u in enumerate(UNITS) if u[6]] + [(6, "class_specifier", "Keeper", 2)]
#: Of each document its language (by turns), units (1 to 8), lines of a unit's body (0 to 5) and empty lines above.
_MADE = ("doc_id % {0} as k, doc_id // {0} % 8 + 1 as n, doc_id // {1} % 6 as b, doc_id // {2} % 5 as s".format(len(UNITS), 8 * len(UNITS), 48 * len(UNITS)))


def units_of(spark: SparkSession, d: str) -> DataFrame:
    """A source text for every document, by its number alone."""
    texts = spark.createDataFrame([(k, *u[:6]) for k, u in enumerate(UNITS)], "k long, ext string, head string, pre string, body string, post string, foot string")
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id is not null").selectExpr("doc_id", *_MADE.replace(" // ", " div ").split(", "))
    unit = F.expr("array_join(transform(sequence(1, cast(n as int)), i -> replace(concat(pre, repeat(body, cast(b as int)), post), '§', cast(i as string))), '')")
    return docs.join(F.broadcast(texts), "k").select(F.concat(F.lit("src/u"), F.col("doc_id"), F.lit("."), F.col("ext")).alias("path"), "ext", F.concat(F.expr("repeat('\n', cast(s as int))"), "head", unit, "foot").alias("content"))  # a text for each entry of UNITS


@query(f"""with sizes(k, ext, head, above, body, below, foot) as (values {_rows(_SIZES)}), around(k, node_type, name, line) as (values {_rows(_AROUND)}),
units(k, node_type, name, lo, lo_below, hi, hi_below, parent, is_test) as (values {_rows(_UNIT_BLOCKS)}),
d as (select 'src/u' || doc_id || '.' || ext as path, ext, m.*, head, above, body, below, foot, above + b * body + below as size from (select doc_id, {_MADE} from documents) m join sizes using (k)),
per as (select path, u.*, s + head + (i - 1) * size as top, b * body as more, i from d join units u using (k), unnest(range(1, n + 1)) t(i))
select path, (s + line)::int as "start", (s + head + n * size + case when foot = 0 then 0 when ext = 'py' then 0 when ext = 'php' or node_type = 'class_specifier' then 1 else foot end)::int as "end", node_type, name, case when node_type = 'class_specifier' then 'a::units' end as parent, ext = 'swift' as is_test from d join around using (k)
union all select path, (top + lo + case when lo_below then more else 0 end)::int, (top + hi + case when hi_below then more else 0 end)::int, node_type, name || i, replace(parent, '§', i::varchar), is_test from per""")
def blocks_of_units(spark, d):
    """Blocks of as many different texts as there are documents, in all languages; the SQL works them out from the texts' making."""
    return blocks.blocks(units_of(spark, d)).select("path", "start", "end", "node_type", "name", "parent", "is_test")


@query(_SOURCE_SQL + f" select path, {_SHIFTED}, node_type, name, parent, is_test from sources join blocks b using (k)")
def blocks_by_language(spark, d):
    return blocks.blocks(sources_of(spark, d)).select("path", "start", "end", "node_type", "name", "parent", "is_test")


@query(_extract_sql([(1, 4, 8, "function_declaration"), (2, 3, 99, "text_search"), (6, 2, 99, "text_search"), (7, 1, 99, "file")]))
def symbol_lookup(spark, d):
    f = sources_of(spark, d)
    return blocks.symbol(blocks.blocks(f), "loadUsers", f)


@query(_extract_sql([(2, 3, 5, "function_definition"), (5, 6, 9, "method_declaration")]))
def nested_symbol(spark, d):
    return blocks.symbol(blocks.blocks(sources_of(spark, d)), "Loader.load")


@query(_extract_sql([(0, 10, 14, "merged_ast_line"), (1, 3, 8, "merged_ast_line"), (2, 1, 8, "merged_ast_line"), (3, 15, 19, "merged_ast_line"), (4, -9, 11, "context"), (7, -9, 11, "context")]))
def extract_line(spark, d):
    f = sources_of(spark, d)
    return blocks.extract(f, blocks.blocks(f), _wanted(spark, d, {"rs": (12, None, None), "js": (3, None, None), "py": (6, None, None), "go": (17, None, None), "c": (1, None, None), "md": (1, None, None)}))


@query(_extract_sql([(0, 2, 15, "merged_ast_range"), (3, 1, 2, "range"), (7, 1, 3, "range"), (1, 10, 19, "merged_ast_range")]))
def extract_range(spark, d):
    f = sources_of(spark, d)
    return blocks.extract(f, blocks.blocks(f), _wanted(spark, d, {"rs": (3, 11, None), "go": (1, 2, None), "md": (1, 99, None), "js": (11, 17, None)}))


@query(_extract_sql([(1, 4, 15, "merged_ast_specific_lines"), (4, -9, 12, "specific_lines"), (7, 1, 99, "file")]))
def extract_lines(spark, d):
    f = sources_of(spark, d)
    return blocks.extract(f, blocks.blocks(f), _wanted(spark, d, {"js": (None, None, [5, 15]), "c": (None, None, [1, 2]), "md": (None, None, None)}))


@query(_extract_sql([(2, 3, 5, "function_definition"), (0, 20, 22, "function_item"), (7, 1, 99, "file")]))
def extract_symbols(spark, d):
    """Targets by symbol, among them one inside another, which goes."""
    f = sources_of(spark, d)
    rows = spark.createDataFrame([("py", "Loader.load"), ("rs", "tests.check"), ("md", "loadUsers")], "ext string, symbol string")
    return blocks.extract(f, blocks.blocks(f), f.join(F.broadcast(rows), "ext").select("path", F.lit(None).cast("int").alias("start"), "symbol"), distinct=True)


@query(_SOURCE_SQL + """ select path, s + 10 as line_start, s + 14 as line_end, 8 as column_start, 5 as column_end, array_to_string((string_split(content, chr(10)))[s + 10 : s + 14], chr(10))[9:] as matched_text from sources where k = 0
union all select path, s + 20, s + 22, 4, 5, array_to_string((string_split(content, chr(10)))[s + 20 : s + 22], chr(10))[5:] from sources where k = 0""")
def structural_pattern(spark, d):
    return blocks.structural(sources_of(spark, d), "fn $NAME$$$REST { $$$BODY }")


@query()
def search_sources(spark, d):
    return search.search(sources_of(spark, d), "load users", 40)


@query()
def search_blocks(spark, d):
    """The whole search over the documents: hits outside of any block give the lines around them."""
    return search.search(files_of(spark, d), "scum AND thre", 25)


@query()
def search_units(spark, d):
    """The whole search over as many source texts as there are documents, no more of them divided into blocks than it takes."""
    return search.search(units_of(spark, d), "+run later OR deep", 40, early=True)


@query()
def search_documents(spark, d):
    return flagship(spark, d)


@query("select vec_id, round(score, 6) as score, row_number() over (order by score desc, vec_id)::int as rank from (select vec_id, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * ((i % 3) - 1))) as score from embeddings) order by score desc, vec_id limit 20")
def rerank_top_k(spark, d):
    q = [(i % 3) - 1 for i in range(1, 65)]
    return rank.rerank(spark.read.parquet(f"{d}/embeddings.parquet"), q, 20).select("vec_id", _round("score").alias("score"), "rank")


@query("select user_id, date_trunc('day', ts) as day, count(*) as n from events group by 1, 2")
def events_by_day(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


