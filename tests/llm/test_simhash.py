import random

import numpy as np
import pytest

from seamfinder.llm import simhash as S
from seamfinder.llm.common import Scratch, components


def brute(rows, k=3):
    fps = [(i, S.fingerprint(t, k)) for i, t in rows]
    label = list(range(len(fps)))
    for x in range(len(fps)):
        for y in range(x):
            if (fps[x][1] ^ fps[y][1]).bit_count() <= 2:
                a, b = label[x], label[y]
                label = [a if q == b else q for q in label]
    best = {}
    for (i, _), c in zip(fps, label):
        if i is not None:
            best[c] = min(best.get(c, i), i)
    return sorted(((i, f, best.get(c)) for (i, f), c in zip(fps, label)), key=str)


def test_fingerprint_by_bits():
    import xxhash

    text = "A b  c\tD e f b c d\x0b x"
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
    assert S.fingerprint(text) == want
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0
    assert S.fingerprint("one Two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_like_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(120):
        base = [f"w{r.randrange(50)}" for _ in range(r.choice([0, 1, 2, 5, 400]))]
        for _ in range(r.choice([1, 1, 3])):
            t = base[:]
            if t and r.random() < 0.7:
                t[r.randrange(len(t))] = "x"
            rows.append((len(rows), " ".join(t)))
    rows += [(None, None), (5, rows[5][1]), (None, "unlike any other text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as fp", "1 as id", "2 as component")
    got = sorted(((x.id, x.fp % 2**64, x.component) for x in S.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("paired", [1, 1000])
def test_links_of_crowds(spark, paired, monkeypatch):
    monkeypatch.setattr(S, "PAIRED", paired)
    r = random.Random(2)
    fps = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(60):
            x = c
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    s = Scratch(spark, "t")
    got = {(x.node, x.root) for x in components(S.links(spark.createDataFrame(signed, "fp long"), s), s).collect()}
    parent = {x: x for (x,) in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                p, q = sorted((top(signed[i][0]), top(signed[j][0])))
                parent[q] = p
    want = {x: top(x) for x in parent}
    alone = {x for x in want if list(want.values()).count(want[x]) == 1}
    assert got == {(x, y) for x, y in want.items() if x not in alone}


def jaccard_components(rows, k=5, similarity=0.8):
    """Components of all pairs, by Python sets of word tuples."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] == sets[y] or both and 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                top[b] = a
    return {rows[x][0]: rows[find(x)][0] for x in range(len(rows))}


def changed(r, words, times):
    """words with so many of them replaced, at random places."""
    w = words[:]
    for at in r.sample(range(len(w)), times):
        w[at] = f"new{r.random()}"
    return w


def test_similar_is_exact_at_the_bar(spark):
    r = random.Random(4)
    rows = []
    for _ in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(304)]
        rows.append((len(rows), " ".join(base)))
        at = r.randrange(20, 45)  # the end replaced: 300 - x of 300 + x shingles are shared, 0.8 is at 33
        rows.append((len(rows), " ".join(base[:-at] + [f"z{r.random()}" for _ in range(at)])))
    rows += [(len(rows) + i, t) for i, t in enumerate(["one two", "One  TWO", "one two three", "a b c d e", "a b c d e f"])]
    got = {x.id: x.component for x in S.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = jaccard_components(rows)
    assert got == want
    assert 10 < sum(want[i] != i for i in range(120)) < 50


def test_similar_in_crowds(spark):
    r = random.Random(6)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    boilerplate, rows = own(228), []
    for _ in range(150):  # all share three quarters; partners differ at the end
        mine = own(76)
        at = r.randrange(15, 40)
        rows += [" ".join(boilerplate + mine), " ".join(boilerplate + mine[:-at] + own(at))]
    base = own(300)
    rows += [" ".join(changed(r, base, r.randrange(3, 12))) for _ in range(200)]  # many near copies, without their origin
    r.shuffle(rows)
    rows = list(enumerate(rows))
    want = jaccard_components(rows)
    got = {x.id: x.component for x in S.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert len(rows) > len(set(want.values())) > 150


def test_bounds_of_pairs():
    r = np.random.default_rng(8)
    for _ in range(200):
        both, a, b = (np.unique(r.integers(0, 2**64, m, np.uint64)) for m in (r.integers(0, 400), r.integers(0, 90), r.integers(0, 90)))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        v = np.stack([np.frombuffer(S.segments(s), np.uint8) for s in (x, y)])
        n = np.array([len(x), len(y)], np.int32)
        apart = len(np.setxor1d(x, y))
        assert np.abs(v[0].astype(int) - v[1]).sum() <= apart and v[0].sum() == len(x)
        if apart <= S._apart(*n, 0.8):
            assert S._close(v, n, np.array([0]), np.array([1]), 0.8).all()
        assert len(np.intersect1d(S.unpacked(S.packed(x)), S.unpacked(S.packed(y)))) == len(np.intersect1d(x, y))


def test_keep_first_of_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a + " x"), (None, "alone here"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as first", "2 as node", "3 as key", "4 as kept", "5 as row")
    got = S.keep_first(df)
    assert got.columns == df.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(1, a), (1, b), (None, "alone here"), (3, None)], key=str)


@pytest.mark.parametrize("short", [1, 1000])
def test_pairs_across_groups(short, monkeypatch):
    monkeypatch.setattr(S, "SHORT", short)
    r = np.random.default_rng(3)
    token = np.sort(r.integers(0, 6, 300))
    n, node = r.integers(80, 120, 300).astype(np.int32), r.permutation(300)
    order = np.lexsort((node, n, token))
    token, n, node, pos, root = token[order], n[order], node[order], np.zeros(300, np.int32), node[order] % 4
    got = {tuple(sorted((x, y))) for i, d in S._across(token, n, pos, node, root, 0.8) for x, y in zip(*np.broadcast_arrays(node[i], node[i + d]))}
    want = {tuple(sorted((node[i], node[j]))) for i in range(300) for j in range(i) if token[i] == token[j] and root[i] != root[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])}
    assert got == want


def test_texts_that_share_a_node_stay(spark, monkeypatch):
    """With nodes of two bits many texts share one; none of them is lost, and copies of first ones still go."""
    import seamfinder.llm.simhash as S
    from pyspark.sql import functions as F

    real = S._node
    monkeypatch.setattr(S, "_node", lambda c: F.pmod(real(c), F.lit(4)))
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, None), (102, "")]
    got = sorted(x.doc_id for x in S.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(range(20)) <= set(got) and 100 not in got


def test_wide_fingerprints_by_bits():
    r = np.random.default_rng(5)
    f = r.integers(0, 2**64, (300, S.LANES), np.uint64)
    for x in range(1, 300, 2):  # partners at many distances
        for at in r.choice(64 * S.LANES, x // 3, replace=False):
            f[x] = f[x - 1] if not at else f[x]
            f[x, at // 64] = f[x - 1, at // 64] ^ np.uint64(1 << int(at % 64))
    c = S.wide_counts(f)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    apart = np.array([sum((int(a) ^ int(b)).bit_count() for a, b in zip(f[x], f[y])) for x, y in zip(i, j)])
    field = lambda x: (c[x][:, :, None] >> np.arange(0, 64, 2, dtype=np.uint64) & np.uint64(3)).astype(int).reshape(len(x), -1)
    bound = np.abs(field(i) - field(j)).sum(1)
    assert (S.wide_manhattan(c[i], c[j]) == bound).all() and (bound <= apart).all()
    for radius in (0, 50, 120):
        assert (S._within(f, c, i, j, radius) == (apart <= radius)).all()
    s = S.shingles("a b c d e f g h i j")
    assert all(int(S.wide_fingerprint(s)[0]) >> b & 1 == (2 * sum(int(x) >> b & 1 for x in s) > len(s)) for b in range(64))


@pytest.mark.parametrize("short, span", [(1, 2), (1024, 2), (1024, 5)])
def test_similar_texts_meet_by_fingerprints(spark, short, span, monkeypatch):
    """The grids by themselves, without the rest: nothing wrong, and nearly all that is right."""
    monkeypatch.setattr(S, "SHORT_CELL", short)
    monkeypatch.setattr(S, "CELL", 800 / (8 / 3) ** span)
    r = random.Random(9)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(250):  # 0.8 is where 33 words differ at the end
        base = own(304)
        at = r.randrange(10, 45)
        rows += [" ".join(base), " ".join(base[:-at] + own(at))]
    base = own(300)
    rows += [" ".join(changed(r, base, r.randrange(3, 12))) for _ in range(150)]
    rows += ["one two", "One  TWO", "", None]
    want = jaccard_components(list(enumerate(rows)))
    s = Scratch(spark, "t")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert S._grids(len(rows), 0.8)[0].shape[1] == span
    part = {x.x: x.r for x in S._by_fingerprints(S._given(df, "text"), 5, 0.8, s).collect()}
    node = {x.doc_id: x.node for x in df.select("doc_id", S._node("text").alias("node")).collect()}
    root = {i: part.get(n, n) for i, n in node.items()}
    linked = [(i, j) for i, j in want.items() if i != j and rows[i]]
    assert all(len({want[i] for i in root if root[i] == x and rows[i]}) <= 1 for x in set(root.values()))
    assert len(linked) > 150 and sum(root[i] == root[j] for i, j in linked) >= 0.98 * len(linked)


def test_keep_first_links_by_fingerprints(spark, monkeypatch):
    """Without the rest the fingerprints still take near copies out: the links are theirs."""
    monkeypatch.setattr(S, "_rest", lambda given, part, *others: part)
    r = random.Random(10)
    rows = []
    for _ in range(30):
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed(r, base, 2)))]
    got = S.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == list(range(0, 60, 2))
