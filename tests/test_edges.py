"""Nulls, ties, repeated rows, empty tables and clashing names in the search operators; the stream of files."""

from pyspark.sql import functions as F

from seamfinder.functions import analyzer
from seamfinder.operators import rank, search, spans
from seamfinder.plans.query import parse
from seamfinder.sources import corpus
from seamfinder.streaming import index

CLASH = ["1 as dl", "2 as n", "3 as tf_0", "'x' as text", "'y' as row", "0.5 as score", "'z' as term"]


def files(spark):
    rows = [("a", "one two two"), ("b", None), ("c", ""), ("d", "two TWO three"), ("d", "two TWO three"), (None, "two"), ("e", "none of it")]
    return spark.createDataFrame(rows, "path string, content string").selectExpr("*", *CLASH)


def test_ranking(spark):
    df = files(spark)
    for tokens in (None, "tokens"):
        given = df.withColumn("tokens", analyzer.words(F.col("content"))) if tokens else df
        got = rank.bm25(given, parse("two", search.plain), tokens, text="content")
        assert got.columns == [c for c in given.columns if c != "score"] + ["score"]
        scores = [(x.path, round(x.score, 9)) for x in got.collect()]
        assert sorted(p or "" for p, _ in scores) == ["", "a", "d", "d"] and len({s for p, s in scores if p == "d"}) == 1
        assert rank.bm25(given.limit(0), parse("two", search.plain), tokens, text="content").count() == 0
        assert {x.path for x in rank.bm25(given, parse("-two", search.plain), tokens, text="content").collect()} == {"b", "c", "e"}
    best = rank.top(rank.bm25(df, parse("two", search.plain), None, text="content"), 3, "path").collect()
    assert [x.rank for x in best] == [1, 2, 3] and all(x.score >= y.score for x, y in zip(best, best[1:]))
    assert search.file_filter(df.limit(0), "two").count() == 0 and search.file_filter(df, "two").count() == 4
    early = {x.path: x.score for x in rank.early_scores(spark.createDataFrame([("a", "t", 1, 110), ("b", "t", 3, 120), ("b", "u", 1, 120)], "path string, term string, tf long, dl long"), 2).collect()}
    assert early["b"] > early["a"] == 0
    assert rank.early_scores(spark.createDataFrame([], "path string, term string, tf long, dl long"), 2).count() == 0
    assert (rank.files_needed(), rank.files_needed(10), rank.files_needed(1000, 50_000)) == (600, 20, 120)


def test_whole_search(spark):
    code = "// users\nfn load_users(a: u8) {\n    open(\"users.db\");\n}\n\nfn other() {\n    close();\n}\n\n// loads nothing\n"
    df = spark.createDataFrame([("src/users.rs", "rs", code), ("none.rs", "rs", None), ("notes.txt", "txt", "see the users\n" + "x\n" * 30)], "path string, ext string, content string")
    got = search.search(df, "load users", 10, merge_gap=None).collect()
    assert [(x.path, x.start, x.end, x.node_type) for x in got][0] == ("src/users.rs", 1, 4, "function_item")
    assert got[0].matched_keywords == ["load", "user"] and got[0].block_unique_terms == 2
    assert {(x.path, x.node_type) for x in got} >= {("notes.txt", "context")}
    exact = search.search(df, 'open("users', 10, exact=True).collect()
    assert [(x.path, x.start, x.end, x.score) for x in exact] == [("src/users.rs", 2, 4, None)]
    seen = spark.createDataFrame([("src/users.rs", 1, 4)], "path string, start int, end int")
    assert not [x for x in search.search(df, "load users", 10, seen=seen, merge_gap=None).collect() if x.path == "src/users.rs" and x.start < 5]
    assert search.search(df.limit(0), "load users").count() == 0


def test_boosts(spark):
    df = spark.createDataFrame([("function_item", 1, 9), ("doc_comment", 1, 5), ("doc_comment", 1, 4), ("unit_test", 1, 1), ("comment", 1, 1), (None, 1, 1), ("identifier", 1, 1), ("enum_item", 1, 1), ("mod_item", 1, 1), ("declaration", 1, 1)], "k string, s int, e int")
    got = [x[0] for x in df.select(rank.boost(F.col("k"), F.col("s"), F.col("e"))).collect()]
    assert got == [2.0, 1.2, 1.0, 0.7, 0.5, 1.0, 1.0, 1.6, 1.4, 1.1]


def test_ranges(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 2, 3), ("a", 11, 12), (None, 1, 2), (None, 2, 9)], "path string, start int, end int")
    assert sorted((str(x.path), x.start, x.end, x.parts) for x in spans.merge(df, gap=5).collect()) == [("None", 1, 9, 2), ("a", 1, 12, 4)]
    assert sorted((str(x.path), x.start, x.end) for x in spans.contained(df).collect()) == [("None", 1, 2), ("None", 2, 9), ("a", 1, 5), ("a", 11, 12)]
    assert spans.merge(df.limit(0)).count() == spans.contained(df.limit(0)).count() == 0
    sized = spark.createDataFrame([("a", 5, 1), ("b", 5, 1), ("c", None, 1), ("d", 9, 1)], "path string, bytes long, tokens long")
    assert [x.path for x in spans.limited(sized, ["bytes", "path"], max_bytes=10).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [x.path for x in spans.limited(sized, ["bytes", "path"], max_bytes=10, skipped=True).collect()] == ["d"]
    assert spans.limited(sized.limit(0), ["bytes", "path"], max_bytes=10).count() == 0


def test_documents_with_nulls(spark):
    docs = spark.createDataFrame([(1, None, "en", "s"), (2, "x", None, None), (None, "y", "en", "s")], "doc_id long, text string, lang string, source string")
    assert sorted((x.path, x.content) for x in corpus.documents_as_files(docs).collect()) == [("-/-/doc_2.txt", "x"), ("s/en/doc_-.txt", "y"), ("s/en/doc_1.txt", "")]


def test_stream_of_files(spark, tmp_path):
    def come(n, rows):
        spark.createDataFrame(rows, "path string, ext string, content string, version long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("path string, ext string, content string, version long").parquet(f"{tmp_path}/in")
        index.maintain(stream, f"{tmp_path}/index", f"{tmp_path}/checkpoint", every=2).awaitTermination()
        return sorted((x.path, x.name) for x in index.current(spark, f"{tmp_path}/index").collect())

    assert come(1, [("a.rs", "rs", "fn one() {}", 1), ("b.rs", "rs", "fn two() {}", 1), ("a.rs", "rs", "fn old() {}", 0)]) == [("a.rs", "one"), ("b.rs", "two")]
    assert come(2, [("a.rs", "rs", "fn three() {}", 2), ("b.rs", "rs", None, 2)]) == [("a.rs", "three")]
