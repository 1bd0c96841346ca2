"""Limits by running totals, and by exact counts of tokens."""

import random

import pytest

from seamfinder.operators import spans
from seamfinder.plans import catalog

SCHEMA = "path string, score double, code string"


def counter():
    return lambda texts: [len((t or "").split()) for t in texts]  # a function of its own, as workers can't import tests


words = counter()


def brute(rows, most, max_results=None, max_bytes=None):
    """One row after the other, with exact sums."""
    kept, size, total = [], 0, 0
    for p, s, code in sorted(rows, key=lambda r: (r[1], r[0])):
        size, total = size + len((code or "").encode()), total + words([code])[0]
        if max_results is not None and len(kept) >= max_results or max_bytes is not None and size > max_bytes or total > most:
            break
        kept.append(p)
    return kept


@pytest.mark.parametrize("seed,longest,most", [(1, 3, 40), (2, 12, 40), (3, 1, 60), (4, 30, 25), (5, 5, 10_000)])
def test_exact_token_limit(spark, seed, longest, most):
    """Words count as tokens here: short ones come to more than the estimate, long ones to less."""
    r = random.Random(seed)
    rows = [(f"p{i}", float(r.randrange(4)), " ".join("x" * r.randrange(1, longest + 1) for _ in range(r.randrange(0, 9)))) for i in range(60)] + [("n", 1.0, None), ("e", 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as rank", "8 as bytes", "9 as place", "1 as exact").drop("place", "exact")
    seen = spark.sparkContext.accumulator(0)

    def count(texts):
        seen.add(len(texts))
        return [len((t or "").split()) for t in texts]

    got = spans.limited_tokens(df.drop("rank"), ["score", "path"], most, count).orderBy("rank").collect()
    assert [x.path for x in got] == brute(rows, most)
    if most < 100:
        assert longest < 5 or seen.value < 62  # not all are counted
        sums = [sum(words([c for _, _, c in sorted(rows, key=lambda r: (r[1], r[0]))][: i + 1])) for i in range(len(got))]
        assert [x.run_tokens for x in got] == sums
    else:
        assert seen.value == len(got) == 62
    for limits in ({"max_results": 7}, {"max_bytes": 90}, {"max_results": 5, "max_bytes": 60}):
        got = spans.limited_tokens(df.drop("rank"), ["score", "path"], most, words, **limits).orderBy("rank").collect()
        assert [x.path for x in got] == brute(rows, most, **limits)


def test_ties_are_dealt_by_the_whole_order(spark):
    """Rows that tie in the first column are in many parts; its type doesn't matter."""
    rows = [("same", f"p{i:04}", i % 7, 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "kind string, path string, bytes long, tokens long")
    got = spans.running(df, ["kind", "path"]).orderBy("rank").collect()
    assert [(x.path, x["rank"], x.run_tokens) for x in got] == [(f"p{i:04}", i + 1, i + 1) for i in range(1000)]
    assert [x.run_bytes for x in got] == [sum(j % 7 for j in range(i + 1)) for i in range(1000)]
    assert spans.limited(df, ["kind", "path"], max_bytes=50).count() == sum(sum(j % 7 for j in range(i + 1)) <= 50 for i in range(1000))
    assert spans.limited_tokens(df.limit(0).selectExpr("*", "'' as code"), ["path"], 5, words).count() == 0


def test_tokens_of_documents(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    data = "/root/testdata/sf0.001"
    own = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    files = sorted(catalog.files_of(spark, data).collect(), key=lambda x: (x.size, x.path))
    total, want = 0, []
    for f in files:
        total += len(own.encode_ordinary(f.content))
        if total > 9000:
            break
        want.append((f.path, len(want) + 1, total))
    assert [tuple(x) for x in catalog.QUERIES["limit_tokens_exact"](spark, data).orderBy("rank").collect()] == want


def test_search_within_tokens(spark):
    from seamfinder.operators import search

    files = spark.createDataFrame([(f"p{i}.rs", "rs", f"fn load_{i}() {{\n    {'x ' * i}\n}}\n") for i in range(1, 30)], "path string, ext string, content string")
    every = search.search(files, "load", 99, merge_gap=None).collect()
    total, want = 0, []
    for x in every:
        total += len(x.code.split())
        if total <= 60:
            want.append(x.path)
    assert [x.path for x in search.search(files, "load", 99, max_tokens=60, count=counter(), merge_gap=None).collect()] == want and 1 < len(want) < 29
