"""Places named in free text; texts and expected places are written down by hand."""

import pytest
from pyspark.sql import functions as F

from seamfinder.operators import targets as T

CASES = [
    ("**tests/common/mod.rs#is_ready (lines 6-7)**: it is", [("tests/common/mod.rs", None, None, "is_ready")]),
    ("*src/main.rs:42* - a line", [("src/main.rs", 42, 42, None)]),
    ("~~old/path.rs~~ and new **path/to/file.rs#name**", [("old/path.rs", None, None, None), ("path/to/file.rs", None, None, "name")]),
    ("```\nsrc/a.rs:3-9\n```, \"b/c.go:1:2\" 'd.py' [text](docs/x.md) | e/f.js | it's g.ts.", [("src/a.rs", 3, 9, None), ("b/c.go", 1, 1, None), ("d.py", None, None, None), ("docs/x.md", None, None, None), ("e/f.js", None, None, None), ("g.ts", None, None, None)]),
    ("***Important: `src/config.rs:25`*** and ~~***gone: `old/legacy.py`***~~", [("src/config.rs", 25, 25, None), ("old/legacy.py", None, None, None)]),
    ("C:\\x\\a.rs:5-10 and C:/y/b.rs#A.b", [("C:\\x\\a.rs", 5, 10, None), ("C:/y/b.rs", None, None, "A.b")]),
    ("https://a.com/b.html:9 http://x.org/src/y.rs (ftp://z/q.c) www", []),
    ("e.g. i.e. self.value data.length list.map x.c config.rs Mr. 3.5", [("x.c", None, None, None), ("config.rs", None, None, None), ("3.5", None, None, None)]),
    ("a.rs:10 a.rs a.rs:10 a.rs#f", [("a.rs", 10, 10, None), ("a.rs", None, None, "f")]),
    ("use `src/**/*.rs` or \"lib/{a,b}.go#f\" but *bold* text", [("src/**/*.rs", None, None, None), ("lib/{a,b}.go", None, None, "f")]),
    ("", []), (None, []), ("no path here, only words", []),
]


def test_places(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string").selectExpr("*", "'x' as path", "1 as start", "'y' as target")
    got = {}
    for x in T.targets(df, "text", "i").collect():
        got.setdefault(x.i, []).append((x.path, x.start, x.end, x.symbol))
    for i, (text, want) in enumerate(CASES):
        assert sorted(got.get(i, []), key=str) == sorted(want, key=str), text
    assert T.targets(df.limit(0)).count() == 0


def test_marks_keep_places(spark):
    texts = ["**a** `b*` \"c\" it's 'd' ~~e~~ ``` x", "https://x.y/z_w.rs end", "`open \"half", "🙂 *é* `ü`"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [x.p for x in df.select(T.plain_text(F.col("text")).alias("p")).collect()]
    assert got == ["  a    b*   c  it's  d    e       x", " " * 18 + " end", " open  half", "🙂  é   ü "]


def test_tests_and_ignored_names(spark):
    df = spark.createDataFrame([("see tests/a.rs:3 and node_modules/x/y.js and src/b.rs",)], "text string")
    paths = lambda **how: {x.path for x in T.targets(df, **how).collect()}
    assert paths() == {"tests/a.rs", "node_modules/x/y.js", "src/b.rs"} and paths(tests=False) == {"node_modules/x/y.js", "src/b.rs"} and paths(tests=False, ignored=False) == {"src/b.rs"}


@pytest.mark.parametrize("glob,want", [
    ("src/*.rs", {"src/a.rs", "src/b+c.rs"}), ("src/**/*.rs", {"src/a.rs", "src/b+c.rs", "src/deep/d.rs"}), ("**/*.go", {"x.go", "src/deep/e.go"}), ("src/{a,b+c}.rs", {"src/a.rs", "src/b+c.rs"}), ("./src/?.rs", {"src/a.rs"}), ("src/deep/**", {"src/deep/d.rs", "src/deep/e.go"}), ("*.go", {"x.go"}), ("none/*", set()), ("src/a.rs", {"src/a.rs"}), ("gone.rs", {"gone.rs"}),
])
def test_globs(spark, glob, want):
    paths = spark.createDataFrame([("src/a.rs",), ("./src/b+c.rs",), ("src/deep/d.rs",), ("src/deep/e.go",), ("x.go",), ("x.go",), (None,)], "path string")
    found = spark.createDataFrame([(1, glob)], "start int, path string")
    assert sorted((x.start, x.path) for x in T.expanded(found, paths).collect()) == sorted((1, w) for w in want)
