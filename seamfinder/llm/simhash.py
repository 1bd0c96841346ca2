"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint becomes the vector of the bit counts of its 32 two-bit
segments. The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so a range join of the vectors finds every pair
of near fingerprints. The join's grid: the segments are cut into ``radius + 3``
blocks; vectors within ``radius`` agree wholly on three of those at least, so
they meet in a cell of one of the grids that three blocks span. What meets is
held against the Manhattan bound and then compared bit by bit.

Only distinct fingerprints are joined, so copies cost nothing. Cells with many
fingerprints are not paired: there the fingerprints that share a midpoint (each
reaches 65 of them by one flipped bit) are tied to the smallest one with it,
which links just what differs in two bits or fewer, in linear space.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, arrow, components

LOW_BITS = 0x5555555555555555
#: Cells up to this size are joined pair by pair, larger ones by midpoints; the links found are the same.
PAIRED = 24


def fingerprint(text: str | None, k: int = 3) -> int:
    """The unsigned fingerprint of a text: majority of the XXH64 (seed 42) of its k-word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = words[at : min(n, at + (1 << 15)) + k - 1]
        grams = [b" ".join(x) for x in zip(*(part[i:] for i in range(k)))] if n > 1 or len(words) >= k else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in grams), np.uint64, len(grams))
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp), fp being the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), k) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text_col).transform(arrow, run, f"id {kind}, fp long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, two bits each."""
    a, b = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def manhattan(a: Column, b: Column) -> Column:
    """The distance of two vectors of counts: fields differ by 1 where their low bits do, else by 2 where they differ."""
    x = a.bitwiseXOR(b)
    low = F.lit(LOW_BITS)
    two = F.shiftrightunsigned(x, 1).bitwiseAND(F.bitwise_not(x)).bitwiseAND(low)
    return F.bit_count(x.bitwiseAND(low)) + 2 * F.bit_count(two)


def _masks(radius: int) -> list[int]:
    blocks = np.array_split(np.arange(32), radius + 3)
    masks = []
    for chosen in combinations(blocks, 3):
        m = sum(3 << (2 * int(s)) for b in chosen for s in b)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def links(fps: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fps at ``radius`` bits or fewer (2 at most).

    fps: one column fp, without repeats.
    """
    if radius > 2:
        raise ValueError("midpoints need a radius of 2 at most")
    grids = F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.col("c").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(_masks(radius))]))
    keyed = fps.withColumn("c", counts(F.col("fp"))).select("fp", "c", grids.alias("k")).select("fp", "c", "k.grid", "k.cell")
    shared = keyed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.keep(keyed.join(shared, ["grid", "cell"]), "met")
    few = met.where(F.col("n") <= PAIRED)
    x, y = few.select("grid", "cell", F.col("fp").alias("a"), F.col("c").alias("ca")), few.select("grid", "cell", F.col("fp").alias("b"), F.col("c").alias("cb"))
    near = (F.col("a") < F.col("b")) & (manhattan(F.col("ca"), F.col("cb")) <= radius) & (hamming(F.col("a"), F.col("b")) <= radius)
    pairs = x.join(y, ["grid", "cell"]).where(near).select("a", "b")
    crowd = met.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]) if radius == 2 else F.array(F.lit(0))
    mids = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    first = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("mid", "a")
    tied = mids.join(first, "mid").where("fp > a").select("a", F.col("fp").alias("b"))
    return scratch.keep(pairs.unionByName(tied).distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over fingerprints at ``radius`` bits or fewer.

    Null or empty texts have fingerprint zero and are linked like others.
    Repeated rows stay as they are. Rows with a null id are kept; their
    component is the smallest id that is not null among the linked rows, null
    if there is none. An empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    s = scratch or Scratch(docs.sparkSession, "simhash")
    fp = s.keep(fingerprints(docs, id_col, text_col, k), "fp")
    least = fp.groupBy("fp").agg(F.min("id").alias("own"))
    root = components(links(least.select("fp"), s, radius), s)
    of = least.join(root, least.fp == root.node, "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    best = of.groupBy("root").agg(F.min("own").alias("component"))
    label = s.keep(of.join(best, "root").select("fp", "component"), "label")
    return fp.join(label, "fp").select("id", "fp", "component")


# texts that are similar rather than almost equal: wide fingerprints of their shingle sets, and the sets themselves

#: 64-bit lanes of a wide fingerprint.
LANES = 4
#: Share of the pairs right at the wanted similarity that meet in a cell of some grid, fingerprints in a cell of unrelated ones (about), and standard errors beyond the expected distance that still count as near. What these leave is found by the rest.
MET, CELL, ERRORS = 0.99, 256, 3
#: Cells up to this size are paired by shifts, larger ones group by group; the pairs are the same.
SHORT_CELL = 1024
#: Grids that are dealt at a time, which bounds the room that their cells take.
DEALT = 48
#: Texts from which the order of the shingles is taken, and how many of them a common shingle has at least. Both only set how many candidates there are.
SAMPLED, COMMON = 20_000, 3
#: Lists of texts up to this length are paired by shifts, longer ones group by group; the pairs are the same.
SHORT = 64
#: Lists that begin with the same text go to one task, so that pairs that they all make are made once; those that are longer than this go to several.
TOGETHER = 256
#: Segments whose shingles are counted for the lower bound (at most 256), and pairs held against it at a time.
SEGMENTS, HELD = 128, 1 << 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct k-word shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, k = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), min(k, len(words))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out *= _M1
        out += h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= _M2
    return np.unique(out ^ out >> np.uint64(29))


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """LANES words: the majority of each bit over a set's shingles, whose hashes are mixed anew for every lane."""
    votes = np.zeros((LANES, 64), np.int64)
    for at in range(0, len(s), 1 << 14):
        h = s[at : at + (1 << 14)]
        for lane in range(LANES):
            votes[lane] += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
            h = (h ^ h >> np.uint64(32)) * _M1
            h ^= h >> np.uint64(29)
    return np.packbits(votes * 2 > len(s), axis=1, bitorder="little").view(np.uint64).ravel()


def wide_counts(f: np.ndarray) -> np.ndarray:
    """counts() of each lane, in numpy."""
    low, one = np.uint64(LOW_BITS), np.uint64(1)
    a, b = f & low, f >> one & low
    return a ^ b | (a & b) << one


def wide_manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """manhattan() over the lanes of rows of counts, in numpy."""
    x, low, one = a ^ b, np.uint64(LOW_BITS), np.uint64(1)
    return np.bitwise_count(x & low).sum(1, dtype=np.int32) + 2 * np.bitwise_count(x >> one & ~x & low).sum(1, dtype=np.int32)


def _within(f: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints differ in ``radius`` bits or fewer: the Manhattan distance of their counts, which is never more, leaves out most, the bits decide."""
    out = np.empty(len(i), bool)
    for at in range(0, len(i), HELD):
        x, y = i[at : at + HELD], j[at : at + HELD]
        near = wide_manhattan(c[x], c[y]) <= radius
        near[near] = np.bitwise_count(f[x[near]] ^ f[y[near]]).sum(1, dtype=np.int32) <= radius
        out[at : at + HELD] = near
    return out


def _grids(n: int, similarity: float) -> tuple[np.ndarray, int]:
    """The segments that span each grid, and the radius, for n fingerprints.

    Bits differ for a share of arccos(2 s / (1 + s)) / pi of pairs at the
    similarity s, and by that the counts of a segment are equal for so many;
    of unrelated ones 3 in 8 are.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    equal, bits = (1 - share) ** 2 + share**2 / 2, 64 * LANES
    span = min(32, max(1, int(np.ceil(np.log(max(1, n) / CELL) / np.log(8 / 3)))))
    many = max(1, int(np.ceil(np.log(1 - MET) / np.log1p(-min(equal**span, 0.999)))))
    r = np.random.default_rng(64)
    chosen = np.stack([r.permutation(bits // 2)[:span] for _ in range(many)])
    return chosen, int(bits * share + ERRORS * np.sqrt(bits * share * (1 - share)))


def segments(s: np.ndarray) -> bytes:
    """How many shingles of a set are in each segment of the hashes, a byte each (255 for more)."""
    of = (s >> np.uint64(56)).astype(np.int64) * SEGMENTS >> 8
    return np.minimum(np.bincount(of, minlength=SEGMENTS), 255).astype(np.uint8).tobytes()


def _close(v: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the Manhattan distance of the counts lets sets be similar; it never exceeds the number of shingles that one of them alone has."""
    out = np.empty(len(i), bool)
    for at in range(0, len(i), HELD):
        x, y = i[at : at + HELD], j[at : at + HELD]
        a, b = v[x], v[y]
        out[at : at + HELD] = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int32) <= _apart(n[x], n[y], similarity)
    return out


def packed(s: np.ndarray) -> bytes:
    """The leading 48 bits of the hashes of a set."""
    return np.ascontiguousarray((s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def prefix(s: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of rare ones first: sets at the similarity share one of them.

    common: sorted shingles that come after all others, by ``often``.
    """
    n = len(s)
    most = n - int(np.ceil(similarity * n - 1e-9)) + 1
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, often[at], 0)
    return s[np.lexsort((s, rank))[:most]] if n else s


def _apart(na, nb, similarity: float):
    """The most shingles that are in one of two similar sets alone."""
    return (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-9


def _could(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets whose first common shingle is at these positions can be similar, by their sizes and what comes after it."""
    need = np.ceil((n[i] + n[j]) * (similarity / (1 + similarity)) - 1e-9)
    return (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * similarity - 1e-9) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)


def _jumps(token, n, pos, node, root, similarity):
    """Pairs (i, j) at distances that are powers of two within the lists of equal tokens."""
    d = 1
    while d < len(token):
        i = np.flatnonzero(token[d:] == token[:-d])
        if not len(i):
            break  # a list is one stretch of rows
        yield i[_could(n, pos, i, i + d, similarity)], d
        d *= 2


def _across(token, n, pos, node, root, similarity, short=None):
    """All pairs (i, j) within the lists of equal tokens whose roots differ; lists are sorted by size."""
    short = short or SHORT
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[start, len(token)])
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    small = mixed & (length <= short)
    i, d = np.flatnonzero(np.repeat(small, length)), 1
    while len(i):
        i = i[i + d < len(token)]
        i = i[(token[i + d] == token[i]) & (n[i] >= n[i + d] * similarity - 1e-9)]  # once a row fails, it fails at every larger distance
        yield i[(root[i] != root[i + d]) & _could(n, pos, i, i + d, similarity)], d
        d += 1
    for at, size in zip(start[mixed & ~small], length[mixed & ~small]):
        rows = np.arange(at, at + size)
        kinds, of, count = np.unique(root[rows], return_inverse=True, return_counts=True)
        for i in rows[of != count.argmax()]:  # each pair has an end outside of the largest group
            other = rows[root[rows] != root[i]]
            yield i, other[_could(n, pos, np.full(len(other), i), other, similarity)] - i


def _pairs(dealt: DataFrame, how, similarity: float, near) -> DataFrame:
    """Distinct candidates (a, b) of nodes from dealt lists (token, n, pos, node, root, and what near reads), sorted by size, by ``how`` and as far as near(n, ...) holds for them."""

    def run(batches):
        held, made = [], 0
        for token, n, pos, node, root, *v in _whole(batches):
            holds = near(n, *v)
            for i, d in how(token, n, pos, node, root, similarity):
                i, j = np.broadcast_arrays(i, i + d)
                met = holds(i, j)
                x, y = node[i[met]], node[j[met]]
                held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                made += len(x)
                if made > 1 << 18:
                    held = [np.unique(np.concatenate(held), axis=0)]
                    made = len(held[0])
                    if made > 1 << 17:
                        yield batch(held)
                        held, made = [], 0
        yield batch(held)

    def batch(found):
        p = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        p = p[p[:, 0] < p[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return dealt.transform(arrow, run, "a long, b long").distinct()


def _whole(batches):
    """Columns of sorted batches as arrays, cut so that no list (rows of one token) is split."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [_counts(c) if pa.types.is_binary(c.type) else np.asarray(c) for c in b.columns]
        last = int(np.searchsorted(now[0], now[0][-1]))
        if last:
            yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in now])]
            held = [[c[last:] for c in now]]
        elif held and held[0][0][0] != now[0][0]:
            yield [np.concatenate(x) for x in zip(*held)]
            held = [now]
        else:
            held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _counts(c: pa.Array) -> np.ndarray:
    """A column of counts by segment as rows."""
    at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, SEGMENTS)


def _alike(pairs: DataFrame, of: DataFrame, similarity: float, s: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by the sets themselves; of: (node, n, v, s)."""

    def side(x: str) -> DataFrame:
        return of.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))

    def same(batches):
        for b in batches:
            keep = []
            for na, sa, nb, sb in zip(*(b.column(i).to_pylist() for i in range(4))):
                both = len(np.intersect1d(unpacked(sa), unpacked(sb), assume_unique=True))
                keep.append(na + nb - 2 * both <= _apart(na, nb, similarity))
            yield pa.RecordBatch.from_arrays(b.columns[4:], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("na", "sa", "nb", "sb", "a", "b")
    return s.keep(both.transform(arrow, same, "a long, b long"), name)


def _node(text_col: str):
    """64 bits of a digest stand for a text; all texts without words are one."""
    t = F.col(text_col)
    return F.conv(F.substring(F.sha2(F.when(t.rlike(WORD), t).otherwise(""), 256), 1, 16), 16, -10).cast("long")


def _other(text_col: str):
    """64 further bits of the same digest, by which texts are told apart that share a node."""
    t = F.col(text_col)
    return F.conv(F.substring(F.sha2(F.when(t.rlike(WORD), t).otherwise(""), 256), 17, 16), 16, -10).cast("long")


def _given(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(_node(text_col).alias("node"), F.col(text_col).alias("text"))


def _sets(given: DataFrame, nodes: DataFrame, k: int, s: Scratch, name: str) -> DataFrame:
    """(node, n, v, s): the sets of these nodes' texts, how many shingles they have, and the counts of those by segment."""

    def sets(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                own = [shingles(t.as_py(), k) for t in b.column(1).slice(at, 64)]
                cols = [pa.array([len(x) for x in own], pa.int32()), pa.array(map(segments, own), pa.binary()), pa.array(map(packed, own), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 64), *cols], names=["node", "n", "v", "s"])

    met = given.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return s.keep(met.select("node", "text").transform(arrow, sets, "node long, n int, v binary, s binary"), name)


def _rooted(of: DataFrame, part: DataFrame | None) -> DataFrame:
    """of with the root of each node, which is itself where there is none yet."""
    if part is None:
        return of.withColumn("root", F.col("node"))
    return of.join(part, of.node == part.x, "left").withColumn("root", F.coalesce("r", "node")).drop("x", "r")


def _joined(part: DataFrame | None, found: DataFrame, s: Scratch, name: str) -> DataFrame:
    """part (x, r) with the links (a, b) that were found."""
    edges = found if part is None else found.unionByName(part.select(F.col("x").alias("a"), F.col("r").alias("b")))
    return s.keep(components(edges, s, f"part-{name}").toDF("x", "r"), f"roots-{name}")


def _wide(given: DataFrame, k: int) -> DataFrame:
    """(node, n, f0, f1, ..., v): the wide fingerprint of each text with words, how many shingles it has, and the counts of those by segment."""
    lanes = [f"f{i}" for i in range(LANES)]

    def prints(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own = [shingles(t.as_py(), k) for t in b.column(1).slice(at, 256)]
                f = np.array([wide_fingerprint(x) for x in own], np.uint64).reshape(-1, LANES).view(np.int64)
                cols = [pa.array([len(x) for x in own], pa.int32()), *(pa.array(f[:, i]) for i in range(LANES)), pa.array(map(segments, own), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), *cols], names=["node", "n", *lanes, "v"])

    return given.transform(arrow, prints, f"node long, n int, {', '.join(f'{x} long' for x in lanes)}, v binary").where("n > 0").dropDuplicates(["node"])


def _cells(prints: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(token, n, node, root, f0, f1, ..., v): a row for the cell of each grid in which a fingerprint is, a cell being equal counts in the grid's segments."""
    lanes = [f"f{i}" for i in range(LANES)]
    place = 3 ** np.arange(chosen.shape[1], dtype=np.int64)

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                c = wide_counts(np.stack([np.asarray(x) for x in part.columns[3:-1]], 1).view(np.uint64))
                each = (c[:, :, None] >> np.arange(0, 64, 2, dtype=np.uint64) & np.uint64(3)).astype(np.int64).reshape(len(c), -1)
                for i, segs in enumerate(chosen):
                    yield pa.RecordBatch.from_arrays([pa.array(each[:, segs] @ place * len(chosen) + i), *part.columns], names=["token", "n", "node", "root", *lanes, "v"])

    fields = ", ".join(f"{x} long" for x in lanes)
    return prints.select("n", "node", "root", *lanes, "v").transform(arrow, spread, f"token long, n int, node long, root long, {fields}, v binary")


def _by_fingerprints(given: DataFrame, k: int, similarity: float, s: Scratch) -> DataFrame:
    """(x, r): nodes that are similar to another by their fingerprints and then by their sets, and the smallest node of their components.

    As in links(), fingerprints become the bit counts of their two-bit
    segments and meet in the cells of grids that some segments span; there they
    are held against the Manhattan bound, then bit by bit, and last against
    the bound of the sets' own counts. The distances of similar texts are too
    large for grids that no pair escapes, so the grids are as many as let MET
    of the pairs right at the similarity meet. Cells are read wholly: at
    distances of powers of two first, then across components.
    """
    prints = s.keep(_wide(given, k), "prints")
    chosen, radius = _grids(prints.count(), similarity)

    def near(n, *cols):
        f, v = np.stack(cols[:-1], 1).view(np.uint64), cols[-1]
        c = wide_counts(f)

        def holds(i, j):
            keep = _within(f, c, i, j, radius)
            keep[keep] = _close(v, n, i[keep], j[keep], similarity)
            return keep

        return holds

    part = None
    dealt = np.array_split(chosen, -(-len(chosen) // DEALT))
    for i, how in enumerate((_jumps, partial(_across, short=SHORT_CELL))):
        met, rooted = None, _rooted(prints, part)
        for j, some in enumerate(dealt):
            cells = _cells(rooted, some).repartition("token").sortWithinPartitions("token", "n", "node")
            lists = cells.select("token", "n", F.lit(0).alias("pos"), "node", "root", *(f"f{x}" for x in range(LANES)), "v")
            found = s.keep(_pairs(lists, how, similarity, near), f"met-{i}-{j}")
            met = found if met is None else met.unionByName(found)
            s.release()
        met = met if len(dealt) == 1 else met.distinct()
        of = _sets(given, met.select(F.explode(F.array("a", "b")).alias("node")).distinct(), k, s, f"sets-{i}")
        part = _joined(part, _alike(met, of, similarity, s, f"near-{i}"), s, str(i))
        s.drop(f"sets-{i}", f"near-{i}", *(f"met-{i}-{j}" for j in range(len(dealt))))
        s.release()
    s.drop("prints", "roots-0")
    return part


def _lists(given: DataFrame, k: int, similarity: float, s: Scratch) -> DataFrame:
    """(token, node, n, pos, route): the lists of texts that share a shingle of their prefixes."""
    one_in = max(1, given.count() // SAMPLED)
    sample = given.where(F.pmod("node", F.lit(one_in)) == 0).dropDuplicates(["node"])

    def all_of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                made = [shingles(t.as_py(), k).view(np.int64) for t in b.column(1).slice(at, 64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made))], names=["token"])

    counted = sample.transform(arrow, all_of, "token long").groupBy("token").agg(F.count("*").alias("often")).where(F.col("often") >= COMMON)
    table = counted.orderBy(F.desc("often"), "token").limit(10 * SAMPLED).toPandas()
    common, often = table["token"].to_numpy(np.int64).view(np.uint64), table["often"].to_numpy(np.int64)
    order = np.argsort(common)
    common, often = common[order], often[order]

    def listed(batches):
        seen = set()  # copies of a text give its shingles once a task; the rest goes in several()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                made = []
                for node, t in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256)):
                    if node in seen:
                        continue
                    seen.add(node)
                    own = shingles(t.as_py(), k)
                    first = prefix(own, similarity, common, often)
                    made.append((first.view(np.int64), np.full(len(first), node, np.int64), np.full(len(first), len(own), np.int32), np.arange(len(first), dtype=np.int32)))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], names=["token", "node", "n", "pos"])

    def several(batches):
        for cols in _whole(batches):
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
            cols = [c[new] for c in cols]
            start = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            length = np.diff(np.r_[start, len(cols[0])])
            parts = (1 + length // TOGETHER).astype(np.uint64)
            route = cols[1][start] ^ ((cols[0][start].view(np.uint64) * _M1 >> np.uint64(32)) % parts * _M2).view(np.int64)
            more = np.repeat(length > 1, length)
            yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in [*cols, np.repeat(route, length)]], names=["token", "node", "n", "pos", "route"])

    fields = "token long, node long, n int, pos int"
    lists = s.keep(given.transform(arrow, listed, fields).repartition("token").sortWithinPartitions("token", "node").transform(arrow, several, fields + ", route long"), "lists")
    s.release()
    return lists


def _rest(given: DataFrame, part: DataFrame, k: int, similarity: float, s: Scratch) -> DataFrame:
    """part with the links that the grids don't show: pairs across components, by lists of texts whose sets could be similar."""
    lists = _lists(given, k, similarity, s)
    of = _sets(given, lists.select("node").distinct(), k, s, "sets")
    s.release()
    counted = s.keep(_rooted(lists.join(of.select("node", "v"), "node"), part), "counted")
    s.drop("lists")
    dealt = counted.repartition("route").sortWithinPartitions("token", "n", "node").select("token", "n", "pos", "node", "root", "v")
    met = s.keep(_pairs(dealt, _across, similarity, lambda n, v: partial(_close, v, n, similarity=similarity)), "met")
    found = _alike(met, of, similarity, s, "near")
    more = part if found.isEmpty() else _joined(part, found, s, "rest")
    s.release()
    s.drop("counted", "sets", "met", "near")
    return more


def _roots(docs: DataFrame, text_col: str, k: int, similarity: float, s: Scratch) -> DataFrame:
    """(x, r): the nodes that are similar to another, and the smallest node of their components."""
    given = _given(docs, text_col)
    return _rest(given, _by_fingerprints(given, k, similarity, s), k, similarity, s)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for every row of docs: components of all pairs of texts whose sets of k-word shingles have that Jaccard similarity.

    Texts meet by the wide fingerprints of their sets, as in
    near_duplicates(): counts of two-bit segments, grids, the Manhattan bound,
    then the bits; and every candidate is decided by its sets. Distances at
    this similarity are random, so some pairs meet in no grid. Those are found
    exactly: sets at the similarity share a shingle among the first ones of
    each in any common order (rare ones first here), and where two components
    share one, the sets decide again. Groups of near copies would be quadratic
    in candidates; so cells are first linked at distances of powers of two,
    and then only pairs across the components found by that are looked at, all
    of them. Null and empty texts are one group; null ids get their group's
    smallest id.
    Repeated rows stay, an empty table gives an empty result, and other
    columns aren't read.
    """
    s = scratch or Scratch(docs.sparkSession, "similar")
    given = docs.select(F.col(id_col).alias("id"), _node(text_col).alias("node"))
    root = _roots(docs, text_col, k, similarity, s)
    of = given.join(root, given.node == root.x, "left").select("id", F.coalesce("r", "node").alias("root"))
    return of.join(of.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group one row stays, that with the smallest id (null ids come last).

    Of rows that repeat an id with texts of one group, one stays; with texts
    of two groups, one of each. Null and empty texts are one group. Should two
    texts share the 64 bits of their node, the one that isn't its first row's
    stays as it is. An empty table gives an empty result; columns of any names
    pass through.
    """
    s = Scratch(docs.sparkSession, "similar")
    given = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _node(text_col).alias("node"), _other(text_col).alias("other"))
    key = F.struct(F.isnull("id").alias("nameless"), "id").alias("key")
    nodes = given.groupBy("node").agg(F.min(key).alias("own"), F.min_by("other", F.struct(key, "other")).alias("first"), F.min("other").alias("low"), F.max("other").alias("high"))
    shared = s.keep(nodes.where("low <> high").select("node", "first"), "shared")  # hardly ever any
    nodes = nodes.select("node", "own")
    root = _roots(docs, text_col, k, similarity, s)
    best = nodes.join(root, nodes.node == root.x, "left").groupBy(F.coalesce("r", "node").alias("root")).agg(F.min(F.struct("own", "node")).alias("best"))
    first = s.keep(best.select(F.col("best.node").alias("kept"), F.col("best.own").alias("of")), "first")
    s.release()
    named = given.withColumn("key", key).join(first, (F.col("node") == F.col("kept")) & (F.col("key") == F.col("of")), "left_semi")
    if shared.isEmpty():
        return named.dropDuplicates(["node", "key"]).select("row.*")
    named = named.join(shared, "node", "left").where(F.col("first").isNull() | (F.col("first") == F.col("other"))).dropDuplicates(["node", "key"])
    odd = given.join(shared, "node").where(F.col("other") != F.col("first"))
    return named.select("row.*").unionByName(odd.select("row.*"))
