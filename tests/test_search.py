"""The whole search: what is found, what it stands for, and the same by plain Python."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seamfinder.functions import analyzer
from seamfinder.operators import pattern, search, spans
from seamfinder.plans import catalog
from seamfinder.plans.query import evaluate, keywords, parse

DATA = "/root/testdata/sf0.001"
RUST = "// about happiness\nfn run_query(a: u8) {\n    open();\n}\n\n// makes it happy\nfn happy() {\n    libraries();\n}\n\nfn other() {\n    cached();\n}\n"
GO = "package m\n\n// IPWhiteListMiddleware handles IP whitelisting\ntype IPWhiteListMiddleware struct {\n\tWhitelist []string\n}\n\n// Process implements it\nfunc (i *IPWhiteListMiddleware) Process() {\n\ttype row struct {\n\t\tmemory int\n\t}\n}\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("src/a.rs", "rs", RUST), ("src/a.rs", "rs", RUST), ("./b.go", "go", GO), ("none.rs", "rs", None), ("empty.rs", "rs", ""), ("notes.txt", "txt", "one query\n" + "x\n" * 40 + "entries of the library\n")]
    return spark.createDataFrame(rows, "path string, ext string, content string").selectExpr("*", "1 as start", "2 as seen", "'x' as code", "0.5 as score")


def found(files, query, **how):
    return [(x.path, x.start, x.end, x.node_type) for x in search.search(files, query, **({"n": 20, "merge_gap": None} | how)).collect()]


def test_words_are_found_by_stem_and_as_written(files):
    assert ("src/a.rs", 2, 4, "function_item") in found(files, "query")
    assert set(found(files, "queries")) == set(found(files, "query")) == {("src/a.rs", 2, 4, "function_item"), ("notes.txt", 1, 6, "context")}
    assert set(found(files, "happy")) == {("src/a.rs", 1, 4, "function_item"), ("src/a.rs", 6, 9, "function_item")}
    assert {x[:2] for x in found(files, "library")} == {("src/a.rs", 7), ("notes.txt", 37)} and {x[0] for x in found(files, "entry")} == {"notes.txt"}
    assert found(files, "ips whitelisting")[0][0] == "./b.go" and found(files, "nothing_like_it") == []


def test_exclusions(files):
    every = set(found(files, "-cached"))
    assert {("src/a.rs", 1, 4, "function_item"), ("src/a.rs", 6, 9, "function_item")} <= every and not any(x[0] == "src/a.rs" and x[1] >= 11 for x in every) and any(x[0] == "notes.txt" for x in every)
    assert ("src/a.rs", 11, 13, "function_item") not in found(files, "cached -other")
    assert found(files, "+query +cached") == [] and found(files, "+query +happy") == [("src/a.rs", 1, 4, "function_item")] and {x[0] for x in found(files, "+query OR happy")} == {"src/a.rs", "notes.txt"}


def test_what_a_line_stands_for(files):
    # a comment its declaration, a type declared in a method the method
    assert found(files, "implements") == [("./b.go", 8, 13, "method_declaration")] and found(files, "memory") == [("./b.go", 9, 13, "method_declaration")]
    assert search.chosen(RUST, "rs", {3, 6}, True) == [(2, 4, "function_item"), (6, 9, "function_item")] and search.chosen(RUST, "txt", {1, 13}) == [(1, 13, "context")]
    rust = "impl A {\n    const N: u8 = 1;\n    fn f() {\n    }\n}\n#[test]\nfn t() {\n    go();\n}\n"
    assert search.chosen(rust, "rs", {2, 3}) == [(1, 5, "impl_item")] and search.chosen(rust, "rs", {3}) == [(3, 4, "function_item")]
    assert search.chosen(rust, "rs", {6, 8}) == [(6, 9, "function_item")] and search.chosen(rust, "rs", {2, 8}, tests=False) == [(1, 5, "impl_item")]
    assert search.chosen("x\n" * 100, "txt", {1, 50, 58, 71}) == [(1, 6, "context"), (45, 63, "context"), (66, 76, "context")]


def test_files_that_repeat_and_sessions(spark, files):
    (x,) = search.search(files, "cached", 5, merge_gap=None).collect()
    assert x.code == "fn other() {\n    cached();\n}" and x.matched_keywords == ["cach"]
    seen = spark.createDataFrame([("./src/a.rs", 1, 4), ("b.go", 1, 99)], "path string, start int, end int")
    assert found(files, "query OR process", seen=seen) == [("notes.txt", 1, 6, "context")]
    assert search.search(files.limit(0), "query").count() == 0 and search.search(files, "query", exact=True).count() == 2


def test_merged_text(spark):
    text = "".join(f"line {i}\n" for i in range(1, 60))
    f = spark.createDataFrame([("a.txt", "txt", text), ("b.txt", "txt", "line 7\n")], "path string, ext string, content string")
    ranked = spark.createDataFrame([("a.txt", 1, 3, "function_item", 3.0, 1, ["b"], 1, 1, "1"), ("a.txt", 9, 10, "context", 2.0, 2, ["a"], 1, 1, "2"), ("a.txt", 40, 41, "x", 1.0, 3, ["c"], 2, 2, "3"), ("b.txt", 1, 1, "context", 0.5, 4, ["a"], 1, 1, "line 7")],
                                   "path string, start int, end int, node_type string, score double, rank int, matched_keywords array<string>, block_unique_terms int, block_total_matches int, code string")
    got = {(x.path, x.start): x for x in search.merged(ranked, f, 5).collect()}
    assert got["a.txt", 1].code == "\n".join(f"line {i}" for i in range(1, 11)) and tuple(got["a.txt", 1])[:8] == ("a.txt", 1, 10, "function_item", 3.0, 1, ["a", "b"], 1)
    assert got["a.txt", 1].block_total_matches == 2 and got["a.txt", 40].code == "3" and got["b.txt", 1].code == "line 7"
    assert [(x.start, x.end) for x in search.merged(ranked.where("path = 'a.txt'"), f, 40).collect()] == [(1, 41)]
    assert "... lines 11-39 skipped..." in search.merged(ranked, f, 40).where("start = 1 and path = 'a.txt'").first().code


def test_merging_goes_on_until_nothing_is_near():
    def brute(ranges, most):
        left, out = sorted(range(len(ranges)), key=lambda i: (ranges[i][0], ranges[i][1], ranges[i][3])), []
        while left:
            i = left.pop(0)
            (s, e, k, r), parts = ranges[i], [i]
            again = True
            while again:
                again = False
                for j in list(left):
                    a, b, c, q = ranges[j]
                    gap = a - e - 1 if a > e else s - b - 1 if s > b else 0
                    called = lambda x: any(w in x for w in ("function", "method", "fn", "func"))
                    far = most * 2 if "comment" in k and called(c) or "comment" in c and called(k) else most
                    if max(gap, 0) <= far:
                        s, e, k, again = min(s, a), max(e, b), k if r <= q else c, True
                        parts.append(j)
                        left.remove(j)
            out.append((s, e, k, parts))
        return out

    import random

    r = random.Random(3)
    for _ in range(400):
        ranges = [(a, a + r.randrange(6), r.choice(["comment", "function_item", "context", "line_comment", "x"]), q) for q, a in enumerate(r.sample(range(1, 80), r.randrange(1, 9)))]
        r.shuffle(ranges)
        assert spans.fixpoint(ranges, 3) == brute(ranges, 3)
    # a comment reaches twice as far to what can be called; with a worse rank it doesn't make the whole a comment
    assert len(spans.fixpoint([(1, 2, "comment", 1), (10, 12, "function_item", 2)], 5)) == 1 and len(spans.fixpoint([(1, 2, "context", 1), (10, 12, "function_item", 2)], 5)) == 2
    assert [x[:3] for x in spans.fixpoint([(1, 2, "function_item", 1), (4, 5, "comment", 2), (14, 15, "comment", 3), (25, 26, "x", 4)], 5)] == [(1, 15, "function_item"), (25, 26, "x")]
    assert spans.with_gaps([str(i) for i in range(1, 40)], 1, 30, [(1, 2), (4, 5), (16, 30), (17, 18)]).split("\n") == ["1", "2", "3", "4", "5", "... lines 6-15 skipped...", *map(str, range(16, 31))]


def test_patterns():
    p = lambda q: pattern.patterns(parse(q, analyzer.tokenize))
    assert p("query") == {"queri": ("queri", "query")} and p("whiteList") == {"white": ("white",), "list": ("list",)} and p("-Query") == {"query": ("query",)} and p('"A b"') == {"a b": ("a b",)}
    h = pattern.hints(parse("sensible caches", analyzer.tokenize))
    assert h == {"sensibl": ("sensib",), "cach": ("cach",)}
    m = pattern.Matcher(parse("sensible query", analyzer.tokenize), ["queri", "sensibl"])
    assert m.lines("Sensibility and\nsensib\nrun_QUERY İ\n" + "query " * 500 + "\nsensible query") == {1: {1}, 3: {0}, 5: {0, 1}}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("query", ["scum AND thre", "stupid idiot -scum", "+tion whing"])
def test_like_python(spark, query):
    """The search over documents, by sorting everything in Python."""
    files = catalog.files_of(spark, DATA).select("path", "ext", "content")
    e, blocks = parse(query, analyzer.tokenize), []
    terms = keywords(e)
    wanted = [k for k in terms if f"-{k}" not in query]
    hints = pattern.hints(e)
    there = lambda k, t: any(h in t.lower() for h in hints[k])
    for f in files.collect():
        if not any(there(k, f.content) for k in terms) or not evaluate(e, {k for k in terms if there(k, f"{f.path}\n{f.content}")}, files=True):
            continue  # candidates are the blocks of files that can match
        lines = f.content.split("\n")
        if not evaluate(e, {k for k in terms if k in analyzer.forms(f"{f.path}\n{f.content}")}, files=True):
            continue  # nor those whose words can't
        hits = [i for i, x in enumerate(lines, 1) if len(x.encode()) <= 2000 and any(p in x.lower() or k in analyzer.tokenize(x) for k in wanted for p in pattern.patterns(e)[k])]
        n, gap, windows = len(lines) - (lines[-1] == "" and len(lines) > 1), 8 if len(hits) > 10 else 6 if len(hits) > 5 else 1, []
        for h in hits:
            s, t = max(1, h - 5), min(n, h + 5)
            if windows and s <= windows[-1][1] + 1 + gap:
                windows[-1][1] = max(t, windows[-1][1])
            else:
                windows.append([s, t])
        for s, t in windows:
            code = "\n".join("" if len(x.encode()) > 500 else x for x in lines[s - 1 : t])
            blocks.append((f.path, s, t, code, analyzer.tokenize(code) + analyzer.tokenize(f.path)))
    import regex

    tf = lambda b, k: b[4].count(k) if k in wanted else len([w for w in regex.split(r"[^\p{L}\p{N}]+", b[3].lower()) if w == k])
    some = [b for b in blocks if any(tf(b, k) for k in terms)]
    avg, df = sum(len(b[4]) for b in some) / len(some), {k: sum(tf(b, k) > 0 for b in some) for k in terms}
    one = lambda b, k: math.log(1 + (len(some) - df[k] + 0.5) / (df[k] + 0.5)) * tf(b, k) * 2.5 / (tf(b, k) + 1.5 * (0.5 + 0.5 * len(b[4]) / avg))
    scored = [(b[0], b[1], b[2], round(sum(one(b, k) for k in wanted), 9), b[3]) for b in some if evaluate(e, {k for k in terms if tf(b, k)})]
    scored.sort(key=lambda x: (-x[3], x[0], x[1]))
    got = [(x.path, x.start, x.end, round(x.score, 9), x.code) for x in search.search(files, query, None, merge_gap=None).collect()]
    assert [x[:4] for x in got] == [x[:4] for x in scored] != []
    assert got == scored
    assert [(x.path, x.start, x.end) for x in search.search(files, query, 7, merge_gap=None).collect()] == [x[:3] for x in scored[:7]]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("query,n", [("scum thre tion", 5), ("scum OR doc", 3), ("+thre stupid -scum", 4), ("qqqq", 3), ("whing", 1000)])
def test_early_results_are_those_of_all_files(spark, monkeypatch, query, n):
    """With the same statistics, the n best are those of dividing all files into blocks; fewer files are."""
    monkeypatch.setattr(search.rank, "FILES_LEAST", 1)
    monkeypatch.setattr(search.rank, "files_needed", lambda n, *_: max(1, n))
    files = catalog.files_of(spark, DATA).select("path", "ext", "content")
    e, looked = parse(query, analyzer.tokenize), []
    given = search.possible(files, e)
    hits, stats = search.early_hits(given, e, n, looked=looked)
    every = search.scored(search.hit_blocks(given, e), e, stats)
    rows = lambda df: [(x.path, x.start, x.end, x.score) for x in df.orderBy(F.desc("score"), "path", "start").limit(n).collect()]
    want = rows(every)
    assert rows(search.scored(hits, e, stats)) == want
    assert sum(looked) <= given.count() and (query not in ("scum thre tion", "scum OR doc") or sum(looked) < given.count())
    assert [(x.path, x.start) for x in search.search(files, query, n, merge_gap=None, early=True).collect()] == [x[:2] for x in want]


def test_one_pass(spark, files):
    """One evaluation in Python for all that is hit; what comes after reads what it wrote."""
    plan = search.search(files, "query", 5, merge_gap=None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Python") == plan.count("MapInArrow") == 0 and plan.count("Relation") <= 3
    assert files.select(F.lit(1)).count() == 6
