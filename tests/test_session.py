import time

import pytest
from pyspark.sql import functions as F

from seamfinder.operators import blocks as B
from seamfinder.operators import session as S
from seamfinder.operators.segment import segment
from seamfinder.sources import corpus, resolve, sinks


def test_sessions(spark, tmp_path):
    files = spark.createDataFrame([("./a.rs", "one"), ("b.rs", "two"), ("c.rs", None)], "path string, content string")
    shown = spark.createDataFrame([("a.rs", 1, 3), ("./b.rs", 1, 2), ("c.rs", 1, 1), ("a.rs", 1, 3)], "path string, start int, end int")
    s = S.Session(spark, f"{tmp_path}/seen", "new")
    assert len(s.name) == 4 and s.unseen("q", shown, files).count() == 4
    s.add("q", shown, files)
    assert s.unseen("q", shown, files).count() == 0 and s.unseen("other", shown, files).count() == 4
    assert S.Session(spark, f"{tmp_path}/seen", s.name).seen("q", files).count() == 3
    assert S.Session(spark, f"{tmp_path}/seen", "else").seen("q", files).count() == 0
    changed = files.withColumn("content", F.when(F.col("path") == "b.rs", "new").otherwise(F.col("content"))).where("path <> 'c.rs'")
    assert {x.path for x in s.unseen("q", shown, changed).collect()} == {"./b.rs", "c.rs"}


def test_timeout(spark):
    slow = spark.range(4).select(F.udf(lambda x: time.sleep(20) or x, "long")("id"))
    began = time.time()
    with pytest.raises(TimeoutError), S.timeout(spark, 1.5):
        slow.collect()
    assert time.time() - began < 15
    with S.timeout(spark, 60):
        assert spark.range(3).count() == 3
    t = S.Timings()
    for _ in range(2):
        with t.stage("x"):
            time.sleep(0.01)
    assert 0.02 <= t.seconds["x"] < 5


def test_dependencies():
    own = {k: lambda m, k=k: f"/{k}/{m}" for k in resolve.LANGUAGES}
    for path, want in (
        ("src/x.rs", "src/x.rs"), ("C:\\x\\a.rs", "C:\\x\\a.rs"), ("go:fmt", "/go/fmt"), ("go:net/http", "/go/net/http"), ("go:net/http/server.go", "/go/net/http/server.go"), ("go:github.com/a/b/c/d.go", "/go/github.com/a/b/c/d.go"),
        ("/dep/go/golang.org/x/net/html", "/go/golang.org/x/net/html"), ("js:express", "/js/express"), ("js:@a/b/lib/x.js", "/js/@a/b/lib/x.js"), ("/dep/js/lodash/map.js", "/js/lodash/map.js"), ("rust:serde", "/rust/serde"), ("/dep/rust/a/b", "/rust/a/b"),
    ):
        assert resolve.resolve(path, own) == want
    assert resolve.divided("go", "github.com/a/b/c/d.go") == ("github.com/a/b", "c/d.go") and resolve.divided("js", "@a/b/c") == ("@a/b", "c")
    for bad in ("go:", "js:../x", "go:a/../b", "js:@a", "js:@/b", "/dep/py/x", "/dep/", "rust:"):
        with pytest.raises(resolve.ResolveError):
            resolve.resolve(bad, own)


def test_files(spark, tmp_path):
    for name, text in {"src/main.rs": "fn a() {}", "src/gen/x.rs": "g", "src/keep.tmp2": "k", "_under/a b+c%.js": "u", ".gitignore": "/src/gen/\n*.tmp2\n!keep.tmp2\nlogs/**\n", "logs/a.txt": "l", "tests/t.rs": "t", "src/x_test.go": "t", "a.json": "{}", "big.rs": "x" * (1 << 20) + "y", "own.skip": "s"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    paths = lambda **how: {x.path for x in corpus.files(spark, str(tmp_path), **how).collect()}
    every = {"src/main.rs", "src/keep.tmp2", "_under/a b+c%.js", "tests/t.rs", "src/x_test.go", "own.skip"}
    assert paths() == every
    assert paths(more=["*.skip"]) == every - {"own.skip"} and paths(gitignore=False) == every | {"src/gen/x.rs", "logs/a.txt"}
    assert paths(tests=False) == every - {"tests/t.rs", "src/x_test.go"} and paths(language="rust") == {"src/main.rs", "tests/t.rs"}
    (tmp_path / "none").mkdir()
    assert corpus.files(spark, str(tmp_path / "none")).count() == 0


def test_sinks(spark):
    df = spark.createDataFrame([("a.rs", 1, 2, "fn x() {}"), ("b.zig", 3, 3, "é")], "path string, start int, end int, code string")
    assert [x.markdown.split("\n")[1] for x in sinks.markdown_rows(df).collect()] == ["```rust", "```"]
    parts = [(x.part, x.json) for x in sinks.json_document(df).collect()]
    assert [p for p, _ in parts].count("results") == 2 and parts[-1][1] == '{"summary":{"count":2,"total_bytes":11,"total_tokens":3},"version":"%s"}' % sinks.VERSION
    assert sinks.xml_summary(df).first().xml == "<summary><count>2</count><total_bytes>11</total_bytes><total_tokens>3</total_tokens></summary>"
    assert sinks.dry_run(df).columns == ["path", "start", "end"]
    assert df.select(sinks.highlighted(F.col("code"), ["FN", "f"], "<", ">").alias("x")).first().x == "<fn> x() {}"


def test_blocks_of_odd_files(spark):
    df = spark.createDataFrame([("a.rs", "rs", None), ("b.rs", "rs", ""), ("c.rs", "rs", "fn a() {\n"), ("d.zig", "zig", "fn a() {}"), ("e.rs", None, "fn a() {}"), ("c.rs", "rs", "fn a() {\n")], "path string, ext string, content string").selectExpr("*", "1 as start", "'x' as name")
    assert [(x.path, x.start, x.end, x.name) for x in B.blocks(df).collect()] == [("c.rs", 1, 1, "a")] * 2
    assert B.blocks(df.limit(0)).count() == 0
    assert [b.name for b in segment("int main(int a)\n{\n}\nvoid f() {\n  g(\"}\");\n}\n", "c")] == ["main", "f"]
    wanted = spark.createDataFrame([("a.rs", 9, None), ("c.rs", 1, 1), ("none.rs", 1, 1)], "path string, start int, end int")
    got = B.extract(df.dropDuplicates(["path"]), B.blocks(df.dropDuplicates(["path"])), wanted).collect()
    assert sorted((x.path, x.start, x.end, x.node_type, x.code) for x in got) == [("a.rs", 1, 1, "context", ""), ("c.rs", 1, 1, "merged_ast_range", "fn a() {")]
