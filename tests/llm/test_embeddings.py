import numpy as np
import pytest

from seamfinder.llm import embeddings as E


def brute(rows, cosine=0.9):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    link = [[False] * len(rows) for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i][j] = link[j][i] = E.exact_cosine(a, b) >= cosine or (a == b).all()
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if link[i][j] and label[i] != label[j]:
                label = [label[j] if q == label[i] else q for q in label]
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((k, sum(link[i]), c, k is not None and k == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("interval,leaf", [(4096, 512), (40, 7)])
def test_like_brute_force(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(E, "INTERVAL", interval)
    monkeypatch.setattr(E.Joiner.__init__, "__defaults__", (leaf,))
    r = np.random.default_rng(3)
    rows = []
    for c in r.normal(size=(25, 8)):
        for _ in range(r.integers(1, 12)):
            rows.append((len(rows), [float(np.float32(x)) for x in (c + r.normal(size=8) * r.choice([0.05, 0.3, 1])) * r.choice([1, 10.0, 1e-3])]))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (502, None), (503, []), (504, [0.0] * 8), (505, [1.0, None] * 4), (506, [float("nan")] * 8), (507, [float("inf")] * 8), (508, [1.0, 2.0]), (509, [2.0, 4.0]), (None, rows[7][1]), (None, [5.0])]
    # exactly at the bound, and just below
    rows += [(600, [9.0, float(np.sqrt(19)), 0.0]), (601, [1.0, 0.0, 0.0]), (602, [8.9, 4.56, 0.0]), (603, [0.0, 0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "'x' as key", "2 as node")
    got = sorted(((x.id, x.n_links, x.component, x.kept) for x in E.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_forest():
    r = np.random.default_rng(4)
    for _ in range(50):
        m = r.random((r.integers(1, 12), r.integers(1, 12))) < 0.2
        a, b = E.forest(m)
        assert all(m[x, y] for x, y in zip(a, b))

        def classes(edges):
            label = list(range(sum(m.shape)))
            for x, y in edges:
                p, q = label[x], label[m.shape[0] + y]
                label = [q if z == p else z for z in label]
            return label

        one, two = classes(zip(a, b)), classes(np.argwhere(m).tolist())
        assert len(set(zip(one, two))) == len(set(one)) == len(set(two)) and len(a) == sum(m.shape) - len(set(two))
