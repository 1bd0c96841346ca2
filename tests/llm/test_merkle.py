import hashlib
import zlib

import pytest

from seamfinder.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    """The levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(*map(part, r)), r))
    trees = {s: sorted(by[s], key=lambda x: x[:3]) for s in sorted(by, key=lambda s: (s is not None, (s or "").encode()))}
    levels = {s: up([x[2] for x in leaves]) for s, leaves in trees.items()}
    top, out = up([x[-1][0] for x in levels.values()]), []
    for k, (s, leaves) in enumerate(trees.items()):
        for at, (_, _, leaf, r) in enumerate(leaves):
            node, others = leaf, []
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = H(*map(part, (*r[:4], r[4].replace("\n", ""))))
            for tree, place in ((levels[s], at), (top, k)):
                for nodes in tree[:-1]:
                    run = nodes[place // 3 * 3 : place // 3 * 3 + 3]
                    own = place % 3
                    node = H(*run[:own], node, *run[own + 1 :])
                    others += run[:own] + run[own + 1 :]
                    place //= 3
            out.append((r[0], leaf, levels[s][-1][0], top[-1][0], H(*others), node, node == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ROWS = [(i, f"s{i % 7}" if i % 3 else "hot", "en", i * 7, f"line {i}\nmore\n" if i % 5 else "plain") for i in range(140)]
ROWS += [(None, "hot", None, None, "a\nb"), (None, None, "en", 3, None), (5, "hot", "en", 1, "x\ny"), (5, "hot", "en", 1, "x\ny"), (6, "", "", 0, ""), (-7, "é:1", "en", 2, "ü\n\n😀"), (2**40, "Z", "en", 2, "w\n" * 50_000), (8, None, "en", None, "\n")]


@pytest.mark.parametrize("levels,top", [(M.LEVELS, M.TOP), (2, 50), (1, 12), (1, 1), (2, 3)])
def test_like_brute_force(spark, levels, top):
    """Blocks and tops of all sizes: the driver's top alone, more rounds within trees, and a round over their roots."""
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as leaf", "'x' as tree", "2 as pos", "3 as id")
    got = M.manifest(df.repartition(5), levels, top)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


@pytest.mark.parametrize("rows", [ROWS[:1], [r for r in ROWS if r[1] == "hot"], [(i, str(i), None, None, None) for i in range(30)]])
def test_single_trees_and_single_leaves(spark, rows):
    for levels, top in ((M.LEVELS, M.TOP), (1, 2)):
        assert sorted(map(tuple, M.manifest(spark.createDataFrame(rows, SCHEMA), levels, top).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tampering_shows(spark):
    """Verified are just the rows whose text stayed."""
    got = {r.doc_id: r.verified for r in M.manifest(spark.createDataFrame(ROWS[:140], SCHEMA)).collect()}
    assert got == {r[0]: not ("\n" in r[4] and zlib.crc32(str(r[0]).encode()) % 2 == 0) for r in ROWS[:140]} and 20 < sum(got.values()) < 120
