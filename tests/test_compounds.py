"""Compounds by a corpus's counts: against all divisions, and 200 compounds of words that code is full of."""

import math
import random
from itertools import permutations

from seamfinder.functions import analyzer, compounds
from seamfinder.functions.compounds import Lattice
from seamfinder.operators import search

PARTS = "white black list fire wall net work end point data base back front code block request response client server auth token parse test case config file name user time key word error handler store cache queue thread pool event loop stream buffer byte string".split()


def brute(word, counts):
    """The best of all divisions, by their geometric means."""
    def all_of(rest):
        if not rest:
            yield []
        for i in range(3, len(rest) + 1):
            if rest[:i] in counts:
                for more in all_of(rest[i:]):
                    yield [rest[:i], *more]

    found = [(sum(math.log(counts[p]) for p in ps) / len(ps), ps) for ps in all_of(word) if len(ps) > 1]
    top = max((m for m, _ in found), default=None)
    if top is None or word in counts and top <= math.log(counts[word]) + 1e-12:
        return [[word]]
    best = [ps for m, ps in found if abs(m - top) < 1e-9]
    return [ps for ps in best if len(ps) == min(map(len, best))]


def test_like_all_divisions():
    r = random.Random(4)
    for _ in range(300):
        counts = {"".join(r.choice("ab") for _ in range(r.randrange(3, 6))): r.randrange(1, 30) for _ in range(14)}
        lattice = Lattice(counts)
        for _ in range(10):
            word = "".join(r.choice("ab") for _ in range(r.randrange(3, 14)))
            want = brute(word, counts)
            assert lattice.split(word) in want, (word, counts)


def test_two_hundred_compounds(spark):
    """A corpus that has the parts often and the compounds seldom: all compounds are divided, the parts aren't."""
    r = random.Random(5)
    pairs = r.sample(list(permutations(PARTS, 2)), 160)
    triples = r.sample(list(permutations(PARTS, 3)), 40)
    made = {"".join(x): list(x) for x in [*pairs, *triples]}
    text = [" ".join(w for w in PARTS for _ in range(8 + i % 5)) for i in range(4)] + [" ".join(made), "IpWhiteListHandler HTTPServer2 the_the forward forward forward ward"]
    files = spark.createDataFrame([(t,) for t in text] + [(None,), ("",)], "content string").selectExpr("*", "'x' as word", "1 as n")
    lattice = Lattice.of(files)
    assert len(made) == 200 and {w: lattice.split(w) for w in made} == made
    assert all(lattice.split(w) == [w] for w in [*PARTS, "forward", "keystone", "ab", "", "listing", "x" * 100])
    assert compounds.counted(files.limit(0)).count() == 0 and compounds.counted(files, most=3).count() == 3
    words = spark.createDataFrame([("whitelist",), (None,), ("zzz",), ("whitelist",)], "word string").selectExpr("*", "1 as parts")
    assert sorted((str(x.word), x.parts) for x in compounds.divided(words, lattice).collect()) == [("None", None), ("whitelist", ["white", "list"]), ("whitelist", ["white", "list"]), ("zzz", ["zzz"])]
    assert analyzer.tokenize("IPFirewallQueue", lattice=lattice) == ["ip", "fire", "wall", *analyzer.tokenize("queue")]


def test_search_by_the_corpus(spark):
    text = "fn threadpool() {\n}\nfn a() { thread(); }\nfn b() { thread(); pool(); }\nfn c() { pool(); }\n"
    files = spark.createDataFrame([("a.rs", "rs", text)], "path string, ext string, content string")
    lattice = Lattice.of(files)
    names = lambda **how: {x.start for x in search.search(files, "+thread +pool", 9, merge_gap=None, **how).collect()}
    assert names() == {4} and names(lattice=lattice) == {1, 4} == names(lattice=lattice, early=True)
    assert {x.start for x in search.search(files, "threadpool", 9, merge_gap=None, lattice=lattice).collect()} == {1, 4}
