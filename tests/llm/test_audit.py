import re
from itertools import permutations

from seamfinder.llm import audit as A


def brute(docs, labels):
    """By applying the filters one after the other, in every order."""
    parts, good, toxic = {}, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for i, lang, text in docs:
        t = text or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs)}
        parts.setdefault(lang or "", []).append((i, {k for k, v in fails.items() if v}))
    out = []
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in rows) - len(gone)
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                steps.append(("".join(order), step, f, len(left), len(gone), redundant, sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out += [(part, o, s, *rest, total[f]) for o, s, f, *rest in steps]
    return sorted(out)


def test_like_brute_force(spark):
    long, caps = " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}" for i in range(250))
    texts = [long, long + " #", caps, "same " * 300, "same " * 300 + "$", "SAME " * 300, "short", "", None, "Short & sweet", caps + "|", long + "\x0b\x0cx", " ", "É" * 40, "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, " ".join(["a"] * 100 + [f"b{i}" for i in range(100)])]
    docs = [(i * 3 % 101, ("en", "de", None, "")[i % 4], texts[i % len(texts)]) for i in range(101)] + [(3, "en", texts[1]), (3, "en", texts[1]), (None, "en", long), (None, None, "short"), (500, "fr", long), (501, "x", "t\n" * 200_000)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 110, 2)] + [(4, 1, None), (5, None, 1), (None, 1, 1), (4, 0, 1), (5, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").selectExpr("*", "1 as part", "2 as quality", "'x' as digest", "'y' as step", "0 as id")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as part")
    got = A.audit(d.repartition(4), l)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
    assert A.audit(d, l.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0
    assert A.audit(d.limit(0), l).count() == 0


def test_shares_are_fair(spark):
    """Shapley values add up to what all filters remove together, in each part."""
    rows = spark.createDataFrame([(i, "en", "x" * i + "#" * (i % 2)) for i in range(40)], "doc_id long, lang string, text string")
    got = A.audit(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EDCBA'").collect()
    assert sum(r.shapley for r in got) == 120 * sum(r.removed for r in got) == 120 * (40 - got[-1].kept)
