import random
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as C  # noqa: E402
from seamfinder.llm import simhash as S  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_similar(spark):
    r = random.Random(12)
    rows, want = [], {}
    for g in range(40):
        words = prose(r, 300).split()
        first = len(rows)
        for c in range(r.choice([1, 1, 2, 6])):
            w = words[:]
            for _ in range(3 if c else 0):
                w[r.randrange(300)] = "changed"
            want[len(rows)] = first
            rows.append((len(rows), " ".join(w)))
    n = len(rows)
    rows += [(n + 1, None), (n + 2, ""), (None, prose(r, 100))]
    want |= {n + 1: n + 1, n + 2: n + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as f0", "2 as node", "3 as id")
    got = {x.id: x.component for x in S.similar(df).collect()}
    assert {k: v for k, v in got.items() if k is not None} == want
    kept = S.keep_first(df.unionByName(df.where("doc_id = 0")))
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(map(str, [*set(want.values()), None])) and kept.columns == df.columns
    assert S.keep_first(df.limit(0)).count() == 0


def test_stages(spark, tmp_path):
    r = random.Random(13)
    rows = []
    for i in range(80):
        rows.append((i, prose(r, 60) + f". login: user{i}\npassword = hunter{i}x\n", "en", r.choice(["a", "b", None]), 0))
    rows += [(100, rows[0][1], "en", "a", 0), (101, None, None, None, None), (102, "x " * 500, "en", "b", 0), (103, "", "en", "b", 0), rows[3]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        seen.append(docs.collect())
    good, dedup, clean, mixed = seen
    assert sorted(x.doc_id for x in good) == sorted([*range(80), 100, 3])
    assert sorted(x.doc_id for x in dedup) == list(range(80))
    assert all("hunter" not in x.text and "<SECRET>" in x.text and x.n_chars == len(x.text) for x in clean)
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x.text))
    total = sum(map(size, clean))
    per = {s: sum(size(x) for x in mixed if x.source == s) for s in ("a", "b", None)}
    assert abs(sum(per.values()) - total) <= 3 and abs(per["a"] - min(total * 5 / 8, 3 * sum(size(x) for x in clean if x.source == "a"))) <= 2
    last = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in last) == sorted(x.doc_id for x in mixed) and all(x.n_tokens == len(x.ids) for x in last)
    assert sorted((x.doc_id, x.ids_sha256) for x in C.run(spark, str(tmp_path)).collect()) == sorted((x.doc_id, x.ids_sha256) for x in last)
    for name, stage in C.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0
