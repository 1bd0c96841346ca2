import random
import re

import numpy as np

from seamfinder.llm import quality as Q


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, x in enumerate(g) if g.count(x) > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics():
    r = random.Random(4)
    for _ in range(200):
        t = "".join(r.choice(["a ", "b ", "é\x85 ", "a\n", "#|", "\x1c", " ", "a a a a a a b\n"]) for _ in range(r.randrange(60)))
        assert Q.statistics(t)[0] == slow(t)
    assert Q.statistics(None)[0] == (0, 0, 0, 0, 0)
    assert Q.statistics("x " * 50000)[0][4] == 50000


def test_trees_learn_and_stay_monotone():
    r = np.random.default_rng(1)
    x = r.random((4000, len(Q.FEATURES)))
    y = ((x[:, 2] < 0.6) & (x[:, 0] > 0.2) ^ (r.random(4000) < 0.02)).astype(float)
    t = Q.fit(x[:3000], y[:3000])
    assert ((t.score(x[3000:]) > 0) == y[3000:]).mean() > 0.94
    for j in np.flatnonzero(Q.MONOTONE):
        z = np.repeat(x[:50], 20, 0)
        z[:, j] = np.tile(np.linspace(-1, 2, 20), 50)
        assert (np.diff(t.score(z).reshape(50, 20), axis=1) <= 1e-12).all()


def test_judge(spark):
    good = "the quick brown fox jumps over a lazy dog while it rains on all of us " 
    rows = [(i, f"{good} word{i} {i * 7}" if i % 3 else f"x{i} ### $$$ *** &&& " + " ".join(f"a{i}{j}###" for j in range(20))) for i in range(90)]
    rows += [(90, None), (91, ""), (92, "a b c d e " * 40), (None, rows[1][1]), rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as features", "1 as score")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(60)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.judge(df, labels).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.id is not None and x.id < 90:
            assert x.kept == bool(x.id % 3), x
    assert {x.id: (x.base_failed, x.kept) for x in got if x.id in (90, 91, 92)} == dict.fromkeys((90, 91, 92), (True, False))
    only = {x.id: x.kept for x in Q.judge(df, labels.limit(0)).collect()}
    assert only[0] and only[1] and not only[90]
    assert Q.judge(df.limit(0), labels).count() == 0


def test_held_out(spark):
    from pathlib import Path

    import pytest

    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    even = Q.judge(docs, labels.where("doc_id % 2 = 0"))
    odd = even.join(labels.where("doc_id % 2 = 1"), even.id == labels.doc_id).select("kept", "quality", "base_failed").collect()
    assert sum(x.kept == bool(x.quality) for x in odd if not x.base_failed) / sum(not x.base_failed for x in odd) > 0.95
