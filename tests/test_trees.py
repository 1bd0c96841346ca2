"""Patterns on trees; what they match is written down by hand."""

import random
import time

import pytest

from seamfinder.operators import blocks as B
from seamfinder.operators import trees as T

RUST = "// fn no() {}\npub fn add(a: u8, b: u8) -> u8 {\n    a + b\n}\n\nfn none() {}\n\nimpl X {\n    fn twice(&self) { go(self.a, \"fn x() {}\"); go(b, b); }\n}\n"
JS = "const add = (a, b) => {\n  return a + b;\n};\nconst one = x => x;\nconst two = (a) => a * 2\nfoo(bar(1), 2)\nif (a == a) { b() } else { c() }\n"
PY = "def f(a, b=(1, 2)):\n    x = 1\n    return x\n\nclass A:\n    def g(self):\n        pass\n    y = 2\n"
CASES = [
    ("rs", RUST, "fn $NAME($$$PARAMS) $$$BODY", ["fn add(a: u8, b: u8) -> u8 {\n    a + b\n}", "fn none() {}", "fn twice(&self) { go(self.a, \"fn x() {}\"); go(b, b); }"]),
    ("rs", RUST, "fn $NAME() {}", ["fn none() {}"]),
    ("rs", RUST, "fn $NAME($$$A) -> $T { $$$B }", ["fn add(a: u8, b: u8) -> u8 {\n    a + b\n}"]),
    ("rs", RUST, "go($A, $A)", ["go(b, b)"]), ("rs", RUST, "go($A, $B)", ['go(self.a, "fn x() {}")', "go(b, b)"]), ("rs", RUST, "impl $X { $$$ }", [RUST[RUST.index("impl") : -1]]),
    ("rs", RUST, "$A + $B", ["a + b"]),
    ("js", JS, "const $NAME = ($$$PARAMS) => $$$BODY", ["const add = (a, b) => {\n  return a + b;\n};", "const two = (a) => a * 2"]),
    ("js", JS, "foo($A, 2)", ["foo(bar(1), 2)"]), ("js", JS, "$A == $A", ["a == a"]), ("js", JS, "if ($A == $A) { $$$T } else { $$$E }", ["if (a == a) { b() } else { c() }"]), ("js", JS, "return $X;", ["return a + b;"]),
    ("py", PY, "def $NAME($$$P): $$$BODY", ["def f(a, b=(1, 2)):\n    x = 1\n    return x", "def g(self):\n        pass"]), ("py", PY, "return $X", ["return x"]), ("py", PY, "class $A: $$$", [PY[PY.index("class") : -1]]),
    ("go", "func a() error {\n\treturn nil\n}\nfunc (x *T) b() {}\n", "func $N() $$$R", ["func a() error {\n\treturn nil\n}"]), ("rb", "def a(x)\n  y\nend\ndef b; end\n", "def $N($$$) $$$B", ["def a(x)\n  y\nend"]),
    ("txt", "fn a() {}", "fn $N() {}", []), ("rs", "", "fn $N() {}", []), ("rs", "fn a( {", "fn $N", ["fn a"]), ("rs", "f(g(x), h(g(x)))", "f($A, h($A))", ["f(g(x), h(g(x)))"]), ("rs", "f(g(x), h(g(y)))", "f($A, h($A))", []),
]


@pytest.mark.parametrize("ext,text,pattern,want", CASES)
def test_matches(ext, text, pattern, want):
    assert [text[s:e] for s, e in T.matches(text, ext, T.compiled(pattern))] == want


def test_patterns_need_both_brackets():
    for bad in ("f(", ")", "f(]", "", "  "):
        with pytest.raises(ValueError):
            T.compiled(bad)


def test_time_grows_with_the_text():
    """Many runs in one pattern on a long flat list; what failed isn't tried again."""
    p, r = T.compiled("f($$$A, $X, $$$B, $X, $$$C, zz)"), random.Random(1)
    began = time.time()
    assert T.matches("f(" + ", ".join(r.choice("abcdefgh") for _ in range(60)) + ")", "rs", p) == []
    assert T.matches("(" * 300 + ")" * 300 + "x " * 20_000, "rs", T.compiled("x $$$A y")) == []
    assert len(T.matches("{" * 20_000 + "a b" + "}" * 20_000, "rs", T.compiled("a $X"))) == 1
    assert time.time() - began < 30


def test_files(spark):
    rows = [("a.rs", "rs", RUST), ("b.js", "js", "function f() {}"), ("tests/c.rs", "rs", "\n  fn t() {}\n"), ("d.rs", "rs", None), ("e.zig", "zig", "fn none() {}"), (None, "rs", "fn n() {}"), ("tests/c.rs", "rs", "\n  fn t() {}\n")]
    df = spark.createDataFrame(rows, "path string, ext string, content string").selectExpr("*", "1 as line_start", "'x' as matched_text")
    got = [tuple(x) for x in B.structural(df, "fn $NAME() {}").collect()]
    assert got == [(None, 1, 1, 0, 9, "fn n() {}"), ("a.rs", 6, 6, 0, 12, "fn none() {}")] + [("tests/c.rs", 2, 2, 2, 11, "fn t() {}")] * 2
    assert B.structural(df, "fn $NAME() {}", language="python").count() == 0 and B.structural(df.limit(0), "x").count() == 0
