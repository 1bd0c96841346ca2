import hashlib
import random

from seamfinder.llm import substring as S


def brute(rows, length=13):
    words = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - length + 1):
                x = tuple(w[k : k + length])
                least[x] = min(least.get(x, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        if i is not None:
            for k in range(len(w) - length + 1):
                if least[tuple(w[k : k + length])] < i:
                    gone.update(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    r = random.Random(8)
    word = lambda: f"w{int(r.expovariate(1 / 30))}"
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 20, 60)]
    rows = []
    for i in range(150):
        t = []
        for _ in range(r.randrange(6)):
            t += r.choice(passages) if r.random() < 0.5 else [word() for _ in range(r.randrange(40))]
        rows.append((i, r.choice([" ", "\n", " \t"]).join(t)))
    r.shuffle(rows)
    for _ in range(20):
        i, t = r.choice(rows)
        w = t.split()
        if w:
            w[r.randrange(len(w))] = "changed"
        rows.append((len(rows) + 100, r.choice([t, " ".join(w)])))
    rows += [(3, "x y " * 20), (3, "x y " * 20), (4, "a " * 5000), (900, "a " * 5001), (None, "x y " * 20), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as digest", "1 as id", "2 as n")
    got = S.deduplicate(df, with_text=True).collect()
    text = {}
    for x in got:
        text[x.id, x.n_words, x.n_removed] = x.kept
    assert sorted(((x.id, x.n_words, x.n_removed, x.kept_sha256) for x in got), key=str) == [x[:4] for x in brute(rows)]
    assert all(x.kept is None if not x.n_removed else hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256 for x in got)
    assert S.deduplicate(df.limit(0)).count() == 0


def test_levels(spark):
    assert S.levels(13) == [4, 7, 13] and S.levels(50) == [4, 7, 13, 25, 50] and S.levels(3) == [2, 3] and S.levels(1) == [1, 1]
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(30)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (1, 3, 6):
        got = S.deduplicate(df, length=length).collect()
        assert sorted(((x.id, x.n_words, x.n_removed, x.kept_sha256) for x in got), key=str) == [x[:4] for x in brute(rows, length)]
    # no candidates survive the first level
    apart = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(30))) for i in range(5)], "doc_id long, text string")
    assert [x.n_removed for x in S.deduplicate(apart).collect()] == [0] * 5


def test_texts_alike_in_40_bits_of_their_digests(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(1, f"{passage} n1603527"), (2, f"{passage} n1920347")]  # found by search: the first 40 bits of xxhash64 of the digests are equal
    got = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.id, x.n_removed) for x in got) == [(1, 0), (2, 13)]
