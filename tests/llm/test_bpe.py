import hashlib
import random

import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from seamfinder.llm import bpe as B  # noqa: E402

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def own():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(P.path(VOCABULARY)), special_tokens={})


def texts():
    r = random.Random(6)
    bits = ["the ", "tion", "é", " ", "  ", "\n", " \n", "\t", "ß", "über", "'ll", "'s", "12345", "!!", "###", "　", " ", "\u0085", "\x1c", "漢字", "\U0001f600", "<|endoftext|>", "aaaaaaaa", "x" * 50, "."]
    return ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(400)] + ["", " ", "a" * 70000, "ab " * 3000, "abc" * 400, "é" * 300]


def test_like_the_library(own, monkeypatch):
    monkeypatch.setattr(B, "LONG", 400)
    coder = B.Coder(B.load_ranks(P.path(VOCABULARY)), P.PATTERN)
    given = texts()
    for t, (ids, csv, raw) in zip(given, coder.encode(pa.array(given)), strict=True):
        assert csv.decode() == ",".join(map(str, ids.tolist()))
        assert csv.decode() == ",".join(map(str, own.encode_ordinary(t))), t[:80]
        assert raw == t.encode()


def test_query(spark, own):
    given = [(i, t) for i, t in enumerate(texts()[:50])] + [(3, None), (None, "x y"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as id")
    got = sorted((str(x.id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in B.encode(df, P.path(VOCABULARY), P.PATTERN).collect())
    h = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((str(i), len(ids := own.encode_ordinary(t or "")), h(",".join(map(str, ids)).encode()), h((t or "").encode())) for i, t in given)
    assert got == want
    full = B.encode(df.where("doc_id < 5"), P.path(VOCABULARY), P.PATTERN, with_ids=True).collect()
    assert all(list(x.ids) == own.encode_ordinary(x.decoded) for x in full)
    assert B.encode(df.limit(0), P.path(VOCABULARY), P.PATTERN).count() == 0
