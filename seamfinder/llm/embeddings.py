"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors at a cosine of c lie sqrt(2 - 2c) = epsilon apart. The vectors are
sorted by the cells, of side epsilon, of their leading principal components, and
cut into intervals of that sequence. Two intervals can hold a link only if their
bounding boxes are no further apart than epsilon; only such pairs are joined, by
halving the longer interval again and again and leaving out halves that are too
distant. Leaves are compared by one matrix product; what float precision can't
settle is settled in double precision.

Pairs of intervals are found by the grid cells of their boxes in the leading
components, and are dealt out in tiles, squares of the sequence against itself:
a tile gets each interval once, however many of its pairs need it. Vectors of
different lengths are in one sequence, by length first, each length with axes of
its own.

Equal vectors are one vector with a count. A leaf gives back sums for every
vector and the edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, components

#: Vectors in an interval, and in a leaf of the recursive join.
INTERVAL, LEAF = 4096, 512
#: The principal directions are those of this many vectors at most (the smallest hashes), and so many lead.
SAMPLE, LEADING = 20_000, 12
#: Components whose cells pairs of intervals are found by.
KEYED = 3
#: Tiles that are wished for at least, and intervals on a tile's side at most.
TILES, SIDE = 96, 8


#: A row of the table of intervals.
BLOCK = "block long, part long, width int, bytes int, lo array<double>, hi array<double>, ids array<long>, counts array<long>, raw binary"


def _vectors(raw: bytes, width: int, size: int) -> np.ndarray:
    """Vectors as doubles; those that single precision holds exactly are stored so."""
    return np.frombuffer(raw, np.float32 if size == 4 else np.float64).reshape(-1, width).astype(np.float64)


def usable(vector: str):
    """Not null, not empty, finite components, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def axes(vectors: np.ndarray, leading: int = LEADING) -> np.ndarray:
    """The leading principal directions of rows, as columns."""
    if not len(vectors):
        return np.zeros((0, 0))
    u = _unit(vectors)
    return np.linalg.eigh(np.cov(u.T) if len(u) > 1 else np.eye(u.shape[1]))[1][:, ::-1][:, :leading].copy()


def forest(mask: np.ndarray) -> tuple[list, list]:
    """Edges (row, column) of a spanning forest of a bipartite graph."""
    rows, cols = np.flatnonzero(mask.any(1)), np.ones(mask.shape[1], bool)
    left, a, b = np.zeros(mask.shape[0], bool), [], []
    left[rows] = True
    for r in rows.tolist():
        if not left[r]:
            continue
        left[r] = False
        front = [r]
        while front:
            new_cols = []
            for q in front:
                c = np.flatnonzero(mask[q] & cols)
                cols[c] = False
                a += [q] * len(c)
                b += c.tolist()
                new_cols += c.tolist()
            front = []
            for c in new_cols:
                q = np.flatnonzero(mask[:, c] & left)
                left[q] = False
                a += q.tolist()
                b += [c] * len(q)
                front += q.tolist()
    return a, b


class Joiner:
    """Links of two intervals of the sequence (or of one with itself)."""

    def __init__(self, cosine: float, basis: np.ndarray, leaf: int = LEAF):
        self.cosine, self.basis, self.leaf = cosine, basis, leaf
        self.reach = 2 - 2 * cosine + 1e-6
        self.sums: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def join(self, a: dict, b: dict) -> None:
        self._halve(a, 0, len(a["id"]), b, 0, len(b["id"]), a is b)

    def _box(self, x: dict, s: int, e: int):
        key = (s, e)
        if key not in x["boxes"]:
            x["boxes"][key] = x["low"][s:e].min(0), x["low"][s:e].max(0)
        return x["boxes"][key]

    def _halve(self, a, s, e, b, t, f, same) -> None:
        if not same:
            (l1, h1), (l2, h2) = self._box(a, s, e), self._box(b, t, f)
            gap = np.maximum(0, np.maximum(l1 - h2, l2 - h1))
            if (gap * gap).sum() > self.reach:
                return
        if max(e - s, f - t) <= self.leaf:
            self._leaf(a, s, e, b, t, f, same)
        elif same:
            m = (s + e) // 2
            self._halve(a, s, m, a, s, m, True)
            self._halve(a, s, m, a, m, e, False)
            self._halve(a, m, e, a, m, e, True)
        elif e - s >= f - t:
            m = (s + e) // 2
            self._halve(a, s, m, b, t, f, False)
            self._halve(a, m, e, b, t, f, False)
        else:
            m = (t + f) // 2
            self._halve(a, s, e, b, t, m, False)
            self._halve(a, s, e, b, m, f, False)

    def _leaf(self, a, s, e, b, t, f, same) -> None:
        g = a["single"][s:e] @ b["single"][t:f].T
        mask = g >= self.cosine
        for i, j in np.argwhere(np.abs(g - self.cosine) < 1e-5).tolist():
            mask[i, j] = exact_cosine(a["raw"][s + i], b["raw"][t + j]) >= self.cosine
        if same:
            np.fill_diagonal(mask, False)
        if not mask.any():
            return
        for of, total in ((a["id"][s:e], mask @ b["count"][t:f]),) + (() if same else ((b["id"][t:f], mask.T @ a["count"][s:e]),)):
            for i in np.flatnonzero(total).tolist():
                self.sums[int(of[i])] = self.sums.get(int(of[i]), 0) + int(total[i])
        x, y = forest(mask)
        self.edges += zip(a["id"][s:e][x].tolist(), b["id"][t:f][y].tolist())

    def interval(self, ids, counts, v: np.ndarray) -> dict:
        u = _unit(v)
        return {"id": np.asarray(ids, np.int64), "count": np.asarray(counts, np.int64), "raw": v, "single": u.astype(np.float32), "low": u @ self.basis, "boxes": {}}


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_links, component, kept) for every row of vectors.

    n_links: other rows at ``cosine`` or more; component: the smallest id
    reachable over such links; kept: id = component. Vectors that are null,
    empty, zero, or hold null or non-finite components, and vectors of
    different lengths, link with nothing. Repeated rows are links of each
    other. A row with a null id counts as a link, but is no component's name.
    An empty table gives an empty result; other columns, labels too, aren't
    read.
    """
    s = scratch or Scratch(vectors.sparkSession, "embeddings")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    given = s.keep(given.withColumn("key", F.when(usable("v"), F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)))).select("id", "key"), "given")
    # node: one number for each distinct vector
    nodes = given.where("key is not null").groupBy("key").agg(F.count("*").alias("count"), F.min("id").alias("least"))
    nodes = s.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    found = s.keep(_join(nodes, cosine, s), "found")

    sums = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    root = components(found.where("b is not null").select("a", "b"), s)
    per = nodes.select("key", "node", "count", "least").join(root.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").join(sums, F.col("node") == F.col("a"), "left") \
        .select("key", F.coalesce("root", "node").alias("root"), "least", (F.col("count") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    per = s.keep(per, "per")
    names = per.groupBy("root").agg(F.min("least").alias("component"))
    label = per.join(names, "root").select("key", "n_links", "component")
    out = given.join(label, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


def _bases(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Axes for each length in a bounded sample; any axes give right results, good ones leave out more."""
    one_in = max(1, nodes.count() // SAMPLE)
    sample = nodes.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0).select("key").limit(2 * SAMPLE).collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r.key), []).append(r.key)
    return {w: axes(np.array(v)) for w, v in by.items()}


def _basis(bases: dict[int, np.ndarray], width: int) -> np.ndarray:
    found = bases.get(width)
    return np.eye(width, min(width, LEADING)) if found is None else found


def _join(nodes: DataFrame, cosine: float, s: Scratch) -> DataFrame:
    """(a, b, n): sums of linked rows for a (b null) and edges (a, b) between distinct vectors; nodes: (key, node, count)."""
    epsilon, bases = math.sqrt(max(0.0, 2 - 2 * cosine)) or 1e-6, _bases(nodes)

    def cells(batches):
        for b in batches:
            made = []
            for v in b.column(0):
                v = np.asarray(v.values, np.float64)
                low = (_unit(v[None]) @ _basis(bases, len(v)))[0]
                with np.errstate(over="ignore"):
                    single = v.astype(np.float32)
                made.append((single if (single == v).all() else v, np.floor(low / epsilon).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x.tobytes() for x, _ in made], pa.binary()), pa.array([x.dtype.itemsize for x, _ in made], pa.int32()), pa.array([len(x) for x, _ in made], pa.int32()), pa.array([c for _, c in made], pa.list_(pa.int64()))],
                                             names=["node", "count", "raw", "bytes", "width", "cell"])

    def intervals(batches):
        from pyspark import TaskContext

        part, number, held, kind = TaskContext.get().partitionId(), 0, [], None

        def made():
            ids, counts, raws = zip(*held)
            low = _unit(_vectors(b"".join(raws), *kind)) @ _basis(bases, kind[0])
            return pa.RecordBatch.from_arrays([
                pa.array([part << 32 | number], pa.int64()), pa.array([part], pa.int64()), pa.array([kind[0]], pa.int32()), pa.array([kind[1]], pa.int32()), pa.array([low.min(0).tolist()]), pa.array([low.max(0).tolist()]),
                pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(counts)], pa.list_(pa.int64())), pa.array([b"".join(raws)], pa.binary())], names=[x.split()[0] for x in BLOCK.split(", ")])

        for b in batches:
            for i, c, r, size, width in zip(*(b.column(k).to_pylist() for k in range(5))):
                if held and (len(held) >= INTERVAL or kind != (width, size)):
                    yield made()
                    held, number = [], number + 1
                kind = (width, size)
                held.append((i, c, r))
        if held:
            yield made()

    seq = nodes.select("key", "node", "count").transform(arrow, cells, "node long, count long, raw binary, bytes int, width int, cell array<long>")
    parts = max(1, min(nodes.count() // INTERVAL, 100_000))
    order = ["width", "bytes", "cell", "node"]
    seq = seq.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("node", "count", "raw", "bytes", "width")
    blocks = s.keep(seq.transform(arrow, intervals, BLOCK), "blocks")

    # pairs of intervals of one width: a join over the cells of the leading components, then the distance of whole boxes
    def boxes(x: str, more: int) -> DataFrame:
        out = blocks.select(F.col("block").alias(x), F.col("part").alias(f"p{x}"), "width", F.col("lo").alias(f"lo{x}"), F.col("hi").alias(f"hi{x}"))
        for i in range(KEYED):
            low, high = F.get(f"lo{x}", F.lit(i)), F.get(f"hi{x}", F.lit(i))
            span = F.sequence(F.floor(low / epsilon).cast("long") - more, F.floor(high / epsilon).cast("long") + more)
            out = out.withColumn(f"c{i}", F.explode(F.coalesce(span, F.array(F.lit(0).cast("long")))))  # vectors may be shorter
        return out

    gap = F.aggregate(F.zip_with(F.zip_with("loa", "hib", lambda p, q: p - q), F.zip_with("lob", "hia", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda t, d: t + d * d)
    near = boxes("a", 1).join(boxes("b", 0), ["width", *(f"c{i}" for i in range(KEYED))]).where((F.col("a") <= F.col("b")) & (gap <= 2 - 2 * cosine + 1e-6))
    pairs = s.keep(near.select("a", "b", "pa", "pb").distinct(), "pairs")
    side = max(1, min(SIDE, math.isqrt(max(1, pairs.count()) // TILES)))
    tiled = pairs.withColumn("tile", F.struct(F.floor(F.col("pa") / side).alias("x"), F.floor(F.col("pb") / side).alias("y")))
    need = tiled.select("tile", F.explode(F.array(F.struct(F.col("a").alias("block"), F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("block"), F.col("a").alias("a"), F.col("b").alias("b")))).alias("x"))
    need = need.groupBy("tile", "x.block").agg(F.collect_set(F.struct("x.a", "x.b")).alias("pairs"))  # as many as a tile's side has blocks
    payload = need.join(blocks.select("block", "width", "bytes", "ids", "counts", "raw"), "block").select(F.col("tile.x").alias("x"), F.col("tile.y").alias("y"), "block", "pairs", "width", "bytes", "ids", "counts", "raw")

    def link(batches):
        tile, held = None, {}

        def linked():
            todo = {(p["a"], p["b"]) for _, ps in held.values() for p in ps}
            ready = {}
            for a, b in sorted(todo):
                for x in {a, b} - ready.keys():
                    width, size, ids, counts, raw = held[x][0]
                    ready[x] = Joiner(cosine, _basis(bases, width)).interval(ids, counts, _vectors(raw, width, size))
                j = Joiner(cosine, _basis(bases, held[a][0][0]))
                j.join(ready[a], ready[b])
                keys = [*j.sums, *(u for u, _ in j.edges)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([None] * len(j.sums) + [v for _, v in j.edges], pa.int64()), pa.array([*j.sums.values()] + [None] * len(j.edges), pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                x, y, block, ps, *rest = (c[i].as_py() for c in batch.columns)
                if held and tile != (x, y):
                    yield from linked()
                    held = {}
                tile = (x, y)
                held[block] = (rest, ps)
        if held:
            yield from linked()

    n = max(1, need.select("tile").distinct().count())
    dealt = payload.repartition(min(n, 100_000), "x", "y").sortWithinPartitions("x", "y", "block")
    return dealt.transform(arrow, link, "a long, b long, n long")
