import math
import random
import re

from seamfinder.llm import mixing as M


def fill(sizes, weights=(5, 2, 1), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        free = [s for s in order if s not in full]
        t = {s: rest * w[s] / sum(w[q] for q in free) for s in free}
        over = [s for s in free if t[s] > limit * sizes[s]]
        if not over:
            return t | full
        full |= {s: limit * sizes[s] for s in over}


def test_mix(spark):
    r = random.Random(3)
    rows = []
    for i in range(900):
        s = r.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"]) if i else "tiny"
        n = min(400, int(r.expovariate(1 / 60))) if s != "tiny" else 2
        rows.append((i, s, r.choice([" ", "\t\n", "\x0b"]).join(["w x"] * n) if r.random() > 0.02 else None))
    rows += [rows[5], (None, "a", "x y z"), (9999, "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "'q' as taken", "2 as target")
    got = M.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = fill(sizes)
    assert sorted((x.id or -1, x.size) for x in got) == sorted((i or -1, size(t)) for i, s, t in rows)
    taken = {}
    for x in got:
        assert 0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size + x.cut and 0 <= x.cut <= x.size
        assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], abs_tol=1e-6)
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 2 + 1e-4 * want[s] for s in want), (taken, want)
    assert sorted(map(str, got)) == sorted(map(str, M.mix(df).collect()))
    assert M.mix(df.limit(0)).count() == 0
