import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from seamfinder.llm import tokenfile as T  # noqa: E402


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=700))
def test_pack(ids):
    words, offsets = T.pack(np.array(ids, np.uint64))
    assert T.unpack(words, offsets, len(ids)).tolist() == ids


def test_density():
    assert len(T.pack(np.ones(128 * 15, np.uint64))[0]) == 15 * 3
    assert len(T.pack(np.full(1280, 1000, np.uint64))[0]) == 10 * 22


def test_frames():
    data = T.frame([None, 3], [2, 0], np.array([5, 2])) + T.frame([9], [1], np.array([2**63]))
    got = [(d, n.tolist(), i.tolist()) for d, n, i in T.frames(io.BytesIO(data))]
    assert got == [([None, 3], [2, 0], [5, 2]), ([9], [1], [2**63])]
    with pytest.raises(ValueError):
        list(T.frames(io.BytesIO(data[:-1])))


def test_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(7)
    bits = ["the ", "tion", "é", " ", "  ", "\n", " \n", "\t", "über", "'ll", "12345", "!!", "　", "\u0085", "\x1c", "漢字", "\U0001f600", "<|endoftext|>", "aaaa", ".", " w", " x", "ñandú", "É", "×", "A", "\n\n", "$$", "_", "it's", "9.5", "\x02", "\u00a0"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(60)))) for i in range(300)]
    r.shuffle(rows)
    rows += [(1000, None), (1001, ""), (None, "first"), (1002, "word " * 100000), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as id")
    got = T.round_trip(df, P.path("byte_bpe_50k.json"), with_ids=True).collect()
    at = 0
    given = {}
    for i, text in rows:
        given.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [2])
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at and x.n_tokens == len(x.ids)
        at += x.n_tokens
        given[x.id].remove(list(x.ids))
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
    ids = [x.id for x in sorted(got, key=lambda x: x.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and not any(given.values())
    assert T.round_trip(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0
