import random
import re

import numpy as np

from seamfinder.llm import pii as P


def slow(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and P.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base():
    r = random.Random(9)
    bits = ["a", "b.", "@", "x@y.z", "1", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111", "٣", "é", "\n", "_%", "00"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(30)))
        assert P.base(t) == slow(t), t
    assert P.base("1" * 100000 + "a" * 100000 + "+" * 1000) == []


def test_gradient():
    model = P.Tagger(1)
    ids, tags = P.examples(3, 2)
    _, grad = model.loss(ids, tags)
    r = np.random.default_rng(5)
    for k, g in grad.items():
        for _ in range(3):
            i = tuple(r.integers(0, n) for n in g.shape)
            old = model.p[k][i]
            model.p[k][i] = old + 1e-5
            up = model.loss(ids, tags)[0]
            model.p[k][i] = old - 1e-5
            down = model.loss(ids, tags)[0]
            model.p[k][i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5, k


def test_held_out():
    ids, tags = P.examples(400, 99)
    got = P.train().decode(ids)
    hit, found, there = ((got == tags) & (tags > 0)).sum(), (got > 0).sum(), (tags > 0).sum()
    assert hit / found > 0.9 and hit / there > 0.9


def test_long_numbers():
    for t in ("0" * 5000 + ".1.2.3", "9" * 5000 + ".1.2.3", "1.2.3." + "0" * 5000, "1.2.3." + "0" * 5000 + "7"):
        m = re.fullmatch(r"0*([0-9]*)\.1\.2\.3|1\.2\.3\.0*([0-9]*)", t)
        assert P.base(t) == ([(0, 1, len(t))] if len(m[1] or m[2] or "") <= 3 else [])


def test_like_decoding_every_window():
    r, model = random.Random(21), P.train()
    texts = ["", "x", "7", "@"]
    for i in range(250):
        parts = []
        while sum(map(len, parts)) < r.choice([30, 120, 700]):
            long_name = "".join(r.choice("abcdefgh.") for _ in range(r.randint(40, 200)))
            parts.append(r.choice([P._sentence(r)[0], "words without any of them " * r.randint(1, 6), long_name + "@mail.org ", "(" * r.randint(1, 90), "4" * r.randint(1, 150)]))
        texts.append("".join(parts))
    known = [P.base(t) for t in texts]
    assert P.learned(texts, known, model) == P.learned(texts, known, model, every=True)
    # what decides a code point, by the rule itself
    for n in (1, 15, 16, 33, 64, 100, 333):
        for q in range(n):
            near = max((min(q - 32 * w, 63 - q + 32 * w), -w) for w in range(n // 32 + 1) if 0 <= q - 32 * w < 64)
            assert P.owner(q) == -near[1]
            s, e = P.owned(P.owner(q), n)
            assert s <= q < e


def test_recall_on_documents():
    """Labelled spans in long texts, of forms that the base patterns miss."""
    r, model, hit, there, wrong = random.Random(31), P.train(), 0, 0, 0
    for _ in range(60):
        text, spans = "", []
        for _ in range(12):
            text += " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 60))) + " "
            part = r.choice([f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}", f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}"])
            spans.append((len(text), 3, len(text) + len(part)))
            text += part + r.choice([". ", ", ", " "])
        got = P.learned([text], [P.base(text)], model)[0]
        hit, there, wrong = hit + len(set(got) & set(spans)), there + len(spans), wrong + len(set(got) - set(spans))
    print("recall", hit / there, "wrong", wrong / there)
    assert hit / there > 0.9 and wrong / there < 0.1


def test_reconciled():
    model = P.train()
    t = "call Maria any time on (743) 555-3824 or leave word with " * 40
    spans = P.learned([t], [[]], model)[0]
    assert sum(k == 3 for _, k, _ in spans) >= 36
    assert all(t[s:e].startswith("(743") or k != 3 for s, k, e in spans)


def test_scan(spark):
    rows = [(1, "write to ann@mail.example.org now"), (2, None), (3, ""), (None, "10.0.0.255"), (1, "write to ann@mail.example.org now"), (4, "w " * 100000 + "+1 (743) 555-3824")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as spans", "1 as id")
    got = sorted((x.id or 0, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_spans) for x in P.scan(df).collect())
    assert got == [(0, 0, 1, 0, 0, "ip:0:10"), (1, 1, 0, 0, 0, "email:9:29"), (1, 1, 0, 0, 0, "email:9:29"), (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, ""), (4, 0, 0, 0, 1, "phone:200000:200017")]
    assert P.scan(df.limit(0)).count() == 0
