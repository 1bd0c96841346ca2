"""Postings and versions: a search by them is the search without them; old versions don't count, before and after compaction."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamfinder.operators import rank, search
from seamfinder.plans import catalog
from seamfinder.streaming import index
from seamfinder.streaming.versions import Versions

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_search_by_postings(spark, tmp_path):
    files = catalog.files_of(spark, DATA).select("path", "ext", "content")
    table = index.posting_table(spark, f"{tmp_path}/postings")
    index.add_postings(table, files.withColumn("version", F.lit(1)))
    for query in ("scum AND thre", "+stupid idiot", "whing", "qqqq"):
        rows = lambda df: [tuple(x) for x in df.collect()]
        want = rows(search.search(files, query, 7))
        assert rows(index.search(files, table, query, 7)) == want and (want or query == "qqqq")
    assert 0 < index.candidates(table, "scum AND thre").count() < files.count()
    assert index.candidates(table, '"of the"') is None is index.candidates(table, "-scum")
    plan = table.rows("scum")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_versions(spark, tmp_path):
    t = Versions(spark, f"{tmp_path}/t", "term string, n long", key="term", buckets=4)
    heads = lambda *x: spark.createDataFrame(x, "path string, version long, deleted boolean")
    rows = lambda *x: spark.createDataFrame(x, "path string, version long, term string, n long")
    now = lambda *keys: sorted((x.path, x.term, x.n) for x in t.rows(*keys).collect())
    assert now() == [] and t.generation() == 0
    t.append(heads(("a", 1, False), ("b", 1, False)), rows(("a", 1, "x", 1), ("a", 1, "y", 2), ("b", 1, "x", 3)))
    t.append(heads(("a", 1, False), ("b", 1, False)), rows(("a", 1, "x", 1), ("a", 1, "y", 2), ("b", 1, "x", 3)))  # once more
    assert now() == [("a", "x", 1), ("a", "y", 2), ("b", "x", 3)] and now("x") == [("a", "x", 1), ("b", "x", 3)] and now("zz") == []
    t.append(heads(("a", 3, False), ("b", 2, True)), rows(("a", 3, "z", 1)), 1)
    t.append(heads(("a", 2, False)), rows(("a", 2, "old", 1)), 2)  # came too late
    assert now() == [("a", "z", 1)]
    t.compact()
    assert now() == [("a", "z", 1)] and t.generation() == 1 and not Path(tmp_path, "t/gen-0").exists()
    t.append(heads(("b", 3, False)), rows(("b", 3, "x", 9)), 3)
    assert now("x", "z") == [("a", "z", 1), ("b", "x", 9)]
    # a generation whose heads aren't written isn't there yet
    Path(tmp_path, "t/gen-2/rows").mkdir(parents=True)
    assert t.generation() == 1 and len(now()) == 2
    t.compact()
    assert t.generation() == 2 and now() == [("a", "z", 1), ("b", "x", 9)]


def test_rescored_by_a_learned_scorer(spark):
    """A scorer fitted on labelled texts, held against putting all texts in its order by hand."""
    r = np.random.default_rng(3)
    words, query = [f"w{i}" for i in range(40)], "w1 w2 w3"
    texts = [" ".join(r.choice(words, r.integers(1, 60))) for _ in range(300)]
    wanted = lambda t: sum(t.split().count(w) for w in query.split()) / len(t.split())
    bag = lambda ts: np.array([[t.split().count(w) / max(1, len(t.split())) for w in words] for t in ts])
    weights = np.linalg.lstsq(bag(texts[:200]), np.array([wanted(t) for t in texts[:200]]), rcond=None)[0]
    sizes = spark.sparkContext.accumulator(0)

    def scorer(q, batch):
        assert q == "w1 w2 w3" and all(t.startswith("// Filename: f") and "\n" in t for t in batch) and (len(batch) == 1 or len(batch) * (max(map(len, batch)) // 4 + 1) <= 200)
        sizes.add(1)
        body = [t.split("\n", 1)[1] for t in batch]
        out = np.array([[t.split().count(w) / max(1, len(t.split())) for w in words] for t in body]) @ weights
        out = np.round(out, 9)
        return [float("nan") if t == "odd" else x for t, x in zip(body, out)]

    rows = [(f"f{i}", i + 1, 1.0, t) for i, t in enumerate([*texts[200:], None, "odd"])]
    ranked = spark.createDataFrame(rows, "path string, rank int, score double, code string").selectExpr("*", "'x' as text", "1 as new")
    got = rank.rescored(ranked, query, scorer, k=60, most=200).collect()
    score = dict(zip((x[0] for x in rows[:60]), (bag([x[3] for x in rows[:60]]) @ weights).tolist()))
    assert [x.path for x in got[:60]] == [x[0] for x in sorted(rows[:60], key=lambda x: (-round(score[x[0]], 12), x[1]))] and [x["rank"] for x in got] == list(range(1, 103))
    assert [x.path for x in got[60:]] == [f"f{i}" for i in range(60, 102)] and all(abs(x.score - score[x.path]) < 1e-9 for x in got[:60]) and sizes.value > 5
    last = rank.rescored(ranked, query, scorer, k=200, most=200).collect()[-1]
    assert last.path == "f101" and np.isnan(last.score)
    # learned, not given: it puts texts with the query's words first
    assert np.corrcoef([score[x[0]] for x in rows[:60]], [wanted(x[3]) for x in rows[:60]])[0, 1] > 0.99
    assert rank.batches_of([5, 1, 9, 2, 2], 6) == [[1, 3, 4], [0], [2]] and rank.batches_of([], 6) == []
    files = spark.createDataFrame([(f"f{i}", "txt", t) for i, t in enumerate(texts[:40])], "path string, ext string, content string")
    best = search.search(files, query, 10, merge_gap=None, scorer=lambda q, ts: [-float(len(t)) for t in ts]).collect()
    assert len(best) == 10 and [len(x.code) + len(x.path) for x in best] == sorted(len(x.code) + len(x.path) for x in best)
