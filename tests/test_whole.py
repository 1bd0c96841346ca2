"""Queries without SQL take in their whole table; held against Python over the same rows."""

import json
import math
from collections import Counter
from pathlib import Path

import pytest

from seamfinder.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def files(spark):
    found = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    return {f"{x.source}/{x.lang}/doc_{x.doc_id}.txt": x.text for x in found if x.text is not None and len(x.text.encode()) <= 1 << 20}


def test_sinks_write_every_document(spark, files):
    (s,) = QUERIES["output_summary"](spark, DATA).collect()
    sizes = [len(t.encode()) for t in files.values()]
    assert tuple(s) == (len(files), sum(sizes), sum(max(1, n // 4) for n in sizes))
    got = [json.loads(x.json) for x in QUERIES["json_rows"](spark, DATA).collect()]
    assert {x["path"]: x["code"] for x in got} == files and len(got) == len(files)
    for name, start in (("xml_rows", "<result><file>{}</file>"), ("markdown_rows", "## {}:1-")):
        rows = [x[0] for x in QUERIES[name](spark, DATA).collect()]
        assert len(rows) == len(files) and sum(any(x.startswith(start.format(p)) for x in rows) for p in files) == len(files)


def test_every_term(spark, files):
    import regex

    tf = {(p, w): n for p, t in files.items() for w, n in Counter(w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w).items()}
    df = Counter(w for _, w in tf)
    assert min(df.values()) == min(tf.values()) == 1
    assert {(x.path, x.term): x.tf for x in QUERIES["term_frequency"](spark, DATA).collect()} == tf
    assert {x.term: x.df for x in QUERIES["doc_frequency"](spark, DATA).collect()} == df
    idf = {x.term: x.idf for x in QUERIES["idf"](spark, DATA).collect()}
    assert idf.keys() == df.keys() and all(abs(idf[w] - math.log(1 + (len(files) - n + 0.5) / (n + 0.5))) < 1e-5 for w, n in df.items())
