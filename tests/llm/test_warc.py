import hashlib
import io

import pytest

from seamfinder.llm import warc as W


def test_reader_finds_damage():
    a, b = W.record(1, "http://x/\n", b"abc" * 900), W.record(2, None, b"", 1, True)
    got = list(W.read(io.BytesIO(a + b), chunk=7))
    assert [h["warc-type"] for h, _ in got] == ["response", "revisit"] and W.payload(got[0][1]) == b"abc" * 900
    import gzip

    body = gzip.decompress(a)
    for bad in (a[:-9], gzip.compress(body.replace(b"abcabc", b"abcabd", 1)), gzip.compress(body[:-5]), gzip.compress(body + b"x"), b"plain", gzip.compress(b"none")):
        with pytest.raises(W.Damaged):
            list(W.read(io.BytesIO(bad)))


def test_round_trip(spark):
    long = "é" * 600
    rows = [(1, "u1", long), (2, "u2", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", long + "x"), (7, "u", long), (7, "u", long), (None, "u", long), (8, "u", "z" * 300000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n", "3 as kept")
    got = W.round_trip(df, with_payload=True).collect()
    top = {}
    for p, _, h in rows:
        if h and len(h.encode()) >= 1000 and p is not None:
            top[h] = max(top.get(h, p), p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        t = top.get(h) if len(data) >= 1000 and p is not None and p != top.get(h) else None
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if t else "response", t, None if t else data))
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, x.payload and bytes(x.payload)) for x in got), key=str) == sorted(((a, b, c, d, e, f or (f if f is None else b"")) for a, b, c, d, e, f in want), key=str)
    assert W.round_trip(df.limit(0)).count() == 0


def test_revisits_are_held_against_their_responses(spark):
    fields = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
    rows = [(2, "response", None, 1500, "aa"), (2, "response", None, 1500, "aa"), (1, "revisit", 2, None, "aa")]
    got = W.resolved(spark.createDataFrame(rows, fields)).collect()
    assert sorted((x.page_id, x.payload_bytes) for x in got) == [(1, 1500), (2, 1500), (2, 1500)]
    for bad in ((1, "revisit", 3, None, "aa"), (1, "revisit", 2, None, "bb"), (1, "revisit", None, None, "aa")):
        with pytest.raises(Exception, match="isn't there or has another digest"):
            W.resolved(spark.createDataFrame([*rows, bad], fields)).collect()
