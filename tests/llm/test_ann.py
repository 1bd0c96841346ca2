import numpy as np
import pytest

from seamfinder.llm import ann as A


def brute(rows, asked, n):
    """By sorting all rows for every query."""
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out, rows = {}, list({(i, str(v)): (i, v) for i, v in rows}.values())
    for q, v in asked:
        if q is None or not fine(v):
            continue
        near = sorted(((float(A.distances(np.array(v, float), np.array([w], float))[0]), i is None, i) for i, w in rows if (i, w) != (q, v) and fine(w) and len(w) == len(v)), key=lambda x: (x[0], x[1], x[2] or 0))
        out.setdefault(q, []).append([(d, i) for d, _, i in near[:n]])
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.id))
    return out


def test_transform_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 16))
    y = A.hadamard(x)
    assert np.allclose(y @ y.T, x @ x.T) and np.allclose(A.hadamard(y), x)


def test_probes_come_in_order_and_are_all_there():
    x = np.random.default_rng(2).normal(size=(5, 6))
    h = A.Hash(6, 2, 3)
    x /= np.linalg.norm(x, axis=1)[:, None]
    probes, own = h.probes(x, 10**6), h.buckets(x)
    assert (probes[:, :, 0] == own).all() and all(sorted(p) == list(range(16 * 16)) for row in probes for p in row)
    for r in range(5):
        for t in range(3):
            s = [h.scores(x, t, k)[r] for k in range(2)]
            costs = [sum((s[k].max() - s[k][c]) ** 2 for k, c in enumerate(divmod(int(p), 16))) for p in probes[r, t]]
            assert np.all(np.diff(costs) > -1e-9)
    assert (h.probes(x, 7) == probes[:, :, :7]).all()


@pytest.mark.parametrize("piece", [8192, 40])
def test_exact_where_all_buckets_are_looked_into(spark, monkeypatch, piece):
    """target 1.0 over a sample of all queries: nothing is lost; ties, repeats, copies in crowds, odd vectors, large and small numbers."""
    monkeypatch.setattr(A, "PIECE", piece)
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(r.normal(size=(300, 12)))]
    rows += [(1000 + i, rows[3][1]) for i in range(120)] + [(i, v) for i, v in rows[:5]]  # a crowd, and rows that are there twice
    rows += [(2000 + i, [float(x) for x in v]) for i, v in enumerate(np.eye(12))] + [(2100 + i, [-float(x) for x in v]) for i, v in enumerate(np.eye(12))]  # many ties
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [1.0, None] * 6), (3004, [float("nan")] * 12), (3005, [float("inf")] * 12), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, rows[7][1]), (None, [5.0] * 12), (3008, [1e300] * 12), (3009, [-1e300] * 12), (3010, [1e-200] * 12), (3011, [2e-200] * 12), (3012, [7.0])]
    asked = [x for x in rows if x[0] is None or x[0] % 10 == 0 or x[0] > 2990]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "'x' as node", "2 as query")
    got, want = answers(A.search(df, df.where("vec_id is null or vec_id % 10 = 0 or vec_id > 2990"), target=1.0)), brute(rows, asked, 10)
    assert set(got) == {q for q, x in want.items() if x[0]}
    for q in got:
        assert got[q] == want[q][0], q
    assert [len(got[q]) for q in (3006, 3007)] == [1, 1] and 3012 not in got
    assert A.search(df.limit(0), df, target=1.0).count() == 0 and A.search(df, df.limit(0)).count() == 0


def test_recall(spark):
    """Held against brute force: clusters, and directions without any structure, where it is hardest."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(6000, 32)), (r.normal(size=(300, 1, 32)) + 0.3 * r.normal(size=(300, 20, 32))).reshape(-1, 32)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = answers(A.search(df, df.where("vec_id % 100 = 0")))
    x = x.astype(np.float32).astype(float)
    hit = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & {i for _, i in found})
        assert all(abs(s - np.sqrt(d[i])) < 1e-12 for s, i in found) and found == sorted(found)
    assert len(got) == 120 and hit >= 0.93 * 1200
