"""Folders listed by jobs, level by level."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seamfinder.sources import corpus, listing


@pytest.fixture
def small(tmp_path):
    for name, text in {"a/b/c/d.rs": "deep", "a/x.rs": "é", "a/.gitignore": "*.tmp\n/b/skip\n!keep.tmp\n", "a/b/skip/no.rs": "", "a/b/y.tmp": "", "a/b/keep.tmp": "k", "other/b/skip/yes.rs": "yes", "other/y.tmp": "t", ".hidden/z": "", "empty/": "", "_u/q r%.js": "q"}.items():
        p = tmp_path / name
        (p if name.endswith("/") else p.parent).mkdir(parents=True, exist_ok=True)
        if not name.endswith("/"):
            p.write_text(text)
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfeok")
    os.symlink(tmp_path / "a", tmp_path / "link")
    return str(tmp_path)


def paths(df):
    return {x.path for x in df.collect()}


def test_rules_are_inherited(spark, small):
    got = listing.listed(spark, small)
    assert paths(got.where("not is_dir")) == {"a/b/c/d.rs", "a/x.rs", "a/b/keep.tmp", "other/b/skip/yes.rs", "other/y.tmp", "_u/q r%.js", "bad.txt"}
    assert paths(got.where("is_dir")) == {"a", "a/b", "a/b/c", "other", "other/b", "other/b/skip", "empty", "_u"}
    assert {(x.path, x.depth, x.size) for x in got.where("name = 'd.rs'").collect()} == {("a/b/c/d.rs", 4, 4)}
    assert "a/b/skip/no.rs" in paths(listing.listed(spark, small, gitignore=False)) and ".hidden/z" in paths(listing.listed(spark, small, hidden=True))
    assert paths(listing.listed(spark, small, ("b", "*.txt"), hidden=False)) == {"a", "a/x.rs", "other", "other/y.tmp", "empty", "_u", "_u/q r%.js"}
    assert paths(listing.listed(spark, small, depth=1)) == {"a", "other", "empty", "_u", "bad.txt"} and listing.listed(spark, f"{small}/none").count() == 0 and listing.listed(spark, f"file://{small}", depth=0).count() == 0


def test_contents_and_views(spark, small):
    got = {x.path: x.content for x in corpus.files(spark, small).collect()}
    assert got["a/x.rs"] == "é" and got["_u/q r%.js"] == "q" and got["bad.txt"] == "\ufffd\ufffdok" and got["a/b/c/d.rs"] == "deep"
    assert paths(corpus.files(spark, small, depth=2)) == {"a/x.rs", "_u/q r%.js", "bad.txt"}
    every = listing.listed(spark, small)
    assert [x.line for x in listing.tree(every, "a").collect()] == ["dir            -  b", "file         2 B  x.rs"]
    assert [x.line.split()[-1] for x in listing.tree(every).collect()] == ["_u", "a", "empty", "other", "bad.txt"]
    assert paths(listing.matching(every, "a/**/*.rs")) == {"a/b/c/d.rs", "a/x.rs"} and paths(listing.matching(every, "a/*.rs")) == {"a/x.rs"} and paths(listing.matching(every, "?.rs")) == {"a/b/c/d.rs", "a/x.rs"}
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 << 30,)], "size long").select(listing.size_text(F.col("size")).alias("t")).collect()
    assert [x.t for x in sizes] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 GB"]


def test_ten_thousand_folders(spark, tmp_path):
    """Listed in as many jobs as there are levels; no task lists more than a few hundred folders."""
    for i in range(100):
        for j in range(100):
            Path(tmp_path, f"d{i}/e{j}").mkdir(parents=True)
    for i in range(0, 100, 10):
        Path(tmp_path, f"d{i}/.gitignore").write_text("e1*/\n")
        for j in range(100):
            Path(tmp_path, f"d{i}/e{j}/f.rs").write_text("x")
    got = listing.listed(spark, str(tmp_path))
    assert got.where("depth = 2").count() == 10_000 - 10 * 11 and got.where("not is_dir").count() == 10 * 89
    assert got.groupBy("path").count().where("count > 1").isEmpty()
