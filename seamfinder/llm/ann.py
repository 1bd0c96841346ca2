"""Nearest neighbours by cross-polytope hashing.

A vector on the unit sphere is turned by pseudo-rotations (random signs, then a
fast Hadamard transform, three times) and named after the signed axis that it is
nearest to. Each of several tables puts every vector into one bucket, so named
by one or more such turns. A query looks into several buckets a table, those of
the next nearest axes after its own; what it finds there is ranked by the exact
distance of the vectors as they are.

How many buckets are looked into is measured, not guessed: the true neighbours
of a bounded sample of queries are found by brute force over all rows, and the
number is that at which the wished share of them is reached. Buckets are dealt
out in pieces of bounded size, so that vectors that crowd together are shared by
many tasks. Equal vectors are one with a list of its smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow
from .embeddings import _unit, usable

#: Tables, and vectors that a bucket is to hold on average at least (more turns name a bucket where there are more).
TABLES, HELD = 8, 256
#: Queries whose true neighbours are sought over all rows, the share of these that is to be reached, and buckets a table that a query may look into at most, but where one turn names a bucket: there it may look into all.
SAMPLE, TARGET, MOST_PROBES = 128, 0.96, 4096
#: Rows of a piece of a bucket, on either side; where that made more than so many large buckets, pieces are larger.
PIECE, MOST_LARGE = 8192, 200_000
#: Numbers under which the name of a bucket has room in 63 bits.
ROOM = 1 << 62


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        v = x.reshape(len(x), -1, 2, h)
        x = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Hash:
    """Tables of cross-polytope hashes for vectors of one length."""

    def __init__(self, width: int, turns: int, tables: int = TABLES):
        self.size = 1 << max(0, width - 1).bit_length()
        while turns > 1 and (2 * self.size) ** turns > ROOM:
            turns -= 1
        self.width, self.turns, self.tables = width, turns, tables
        self.signs = np.random.default_rng([11, width]).choice([-1.0, 1.0], (tables, turns, 3, self.size))

    def scores(self, unit: np.ndarray, table: int, turn: int) -> np.ndarray:
        """How near each row is to each signed axis."""
        y = np.zeros((len(unit), self.size))
        y[:, : self.width] = unit
        for signs in self.signs[table, turn]:
            y = hadamard(y * signs)
        return np.concatenate([y, -y], 1)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """A bucket for each row and table."""
        out = np.zeros((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            for k in range(self.turns):
                out[:, t] = out[:, t] * (2 * self.size) + self.scores(unit, t, k).argmax(1)
        return out

    def probes(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The buckets for each row and table, best first, as many as there are but ``most`` at most; their own come first."""
        most = min(most, (2 * self.size) ** self.turns)
        out = np.zeros((len(unit), self.tables, most), np.int64)
        for t in range(self.tables):
            costs = [(s.max(1, keepdims=True) - s) ** 2 for s in (self.scores(unit, t, k) for k in range(self.turns))]
            for r in range(len(unit)):
                total, code = np.zeros(1), np.zeros(1, np.int64)
                for c in costs:  # the best sums are sums of the best
                    order = np.argsort(c[r], kind="stable")[:most]
                    grid = (total[:, None] + c[r][order]).ravel()
                    pick = np.argsort(grid, kind="stable")[:most]
                    total, code = grid[pick], code[pick // len(order)] * (2 * self.size) + order[pick % len(order)]
                out[r, t] = code
        return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to q, in double precision; what would overflow or vanish as a square is scaled."""
    diff = np.abs(x - q)
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        out = np.sqrt((diff * diff).sum(1))
        top = diff.max(1)
        odd = (top > 1e150) & np.isfinite(top) | (top < 1e-150) & (top > 0)
        out[odd] = top[odd] * np.sqrt(((diff[odd] / top[odd, None]) ** 2).sum(1))
    return out


def nearest(q: np.ndarray, x: np.ndarray, ties: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the places and distances of the n nearest rows of x, the smaller tie first where they are equal."""
    with np.errstate(over="ignore", invalid="ignore"):
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        rough = qq[:, None] + xx[None] - 2 * (q @ x.T)
        error = 1e-12 * (qq + (xx.max() if len(xx) else 0)) + 1e-300
    out = []
    for i in range(len(q)):
        few = np.arange(len(x))
        if len(x) > n and np.isfinite(rough[i]).all() and error[i] > 1e-290:
            few = np.flatnonzero(rough[i] <= np.partition(rough[i], n - 1)[n - 1] + 2 * error[i])
        d = distances(q[i], x[few])
        order = np.lexsort((ties[few], d))[:n]
        out.append((few[order], d[order]))
    return out


def matrices(column: pa.Array):
    """(places, rows of doubles) for each length that vectors of a column have."""
    lengths, values = np.asarray(pc.list_value_length(column)), np.asarray(column.flatten(), np.float64)
    starts = np.r_[0, np.cumsum(lengths)]
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        yield rows, (values if len(rows) == len(lengths) else np.concatenate([values[starts[r] : starts[r + 1]] for r in rows])).reshape(len(rows), width)


def search(vectors: DataFrame, wanted: DataFrame, n: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET, tables: int = TABLES, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, id, score): the n nearest rows of vectors found for each row of wanted, which has the same columns.

    score is the Euclidean distance of the vectors as they are; equal ones come
    in the order of ids, null ids last. Rows that repeat an id with its vector
    are one row, and the query's own isn't its neighbour; a row with the
    query's id and another vector is. Rows of other lengths aren't neighbours,
    nor are null or empty vectors, zero ones and those with null or non-finite
    components, on either side. Each query is answered once, and those without
    an id aren't. A query gets all rows that it can have where these are fewer
    than n. Empty tables give an empty result; other columns aren't read.

    target: the share of true neighbours to be reached, held against brute
    force for SAMPLE queries. Those that find fewer than n rows look into all
    buckets.
    """
    s = scratch or Scratch(vectors.sparkSession, "ann")
    spare = n + 1  # its own may be among them

    def named(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = df.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).alias("v"))
        return fine.withColumn("node", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v"))))

    first = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last())
    nodes = named(vectors).dropDuplicates(["node", "id"]).withColumn("at", F.row_number().over(first)).where(F.col("at") <= spare).groupBy("node")
    nodes = s.keep(nodes.agg(F.first("v").alias("v"), F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids")), "nodes")
    asked = s.keep(named(wanted).where("id is not null").select("id", "node", "v"), "asked")
    queries = s.keep(asked.groupBy("node").agg(F.first("v").alias("v")), "queries")

    turns, probes = _measured(nodes, queries, n, target, tables)
    found = _looked(nodes, queries, spare, turns, probes, tables, s, "found")
    # those that lack rows: one table whose every bucket is looked into
    there = nodes.groupBy(F.size("v").alias("width")).agg(F.sum(F.size("ids")).alias("all"))
    have = queries.select("node", F.size("v").alias("width")).join(found.groupBy("query").agg(F.sum(F.size("ids")).alias("n")), F.col("node") == F.col("query"), "left")
    short = have.join(there, "width").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(spare), F.col("all"))).select("node")
    lacking = s.keep(queries.join(short, "node", "left_semi"), "lacking")
    if not lacking.isEmpty():
        rest = _looked(nodes, lacking, spare, 1, MOST_PROBES, 1, s, "rest", every=True)
        found = found.join(lacking.select(F.col("node").alias("query")), "query", "left_anti").unionByName(rest)

    ordered = Window.partitionBy("query").orderBy("score", F.col("id").asc_nulls_last())
    near = found.select("query", "score", (F.col("query") == F.col("node_id")).alias("same"), F.explode("ids").alias("id")).withColumn("at", F.row_number().over(ordered)).where(F.col("at") <= spare)
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score", "same"))).alias("near"))
    own = asked.select("id", "node").distinct().withColumnRenamed("id", "query_id").join(lists, F.col("node") == F.col("query"))
    others = F.slice(F.filter("near", lambda x: ~x["same"] | x["id"].isNull() | (x["id"] != F.col("query_id"))), 1, n)
    return own.select("query_id", F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def _measured(nodes: DataFrame, queries: DataFrame, n: int, target: float, tables: int) -> tuple[int, int]:
    """(turns, probes) that reach the target for the neighbours, by brute force over all nodes, of a sample of queries."""
    sample = queries.orderBy("node").limit(SAMPLE).collect()  # names are hashes
    given = [(r.node, np.asarray(r.v, np.float64)) for r in sample]
    if not given:
        return 1, 1

    def true(batches):
        best: dict[int, tuple] = {}
        for b in batches:
            names = np.asarray(b.column(0).to_pylist(), object)
            for rows, x in matrices(b.column(1)):
                mine = [i for i, (_, v) in enumerate(given) if len(v) == x.shape[1]]
                if not mine:
                    continue
                for i, (at, d) in zip(mine, nearest(np.array([given[i][1] for i in mine]), x, np.arange(len(x)), n + 1)):
                    other = names[rows[at]] != given[i][0]
                    old = best.get(i, (np.zeros(0), np.zeros((0, x.shape[1]))))
                    d, v = np.r_[old[0], d[other]], np.concatenate([old[1], x[at[other]]])
                    order = np.argsort(d, kind="stable")[:n]
                    best[i] = d[order], v[order]
        rows = [(i, float(d), v.tolist()) for i, (ds, vs) in best.items() for d, v in zip(ds, vs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["q", "d", "v"])

    w = Window.partitionBy("q").orderBy("d")
    truth = nodes.select("node", "v").transform(arrow, true, "q int, d double, v array<double>").withColumn("at", F.row_number().over(w)).where(F.col("at") <= n).select("q", "v").collect()  # SAMPLE * n rows at most
    if not truth:
        return 1, 1
    of: dict[int, list] = {}
    for r in truth:
        of.setdefault(r.q, []).append(r.v)
    rows, size = nodes.count(), max(2 * Hash(len(v), 1, 1).size for _, v in given)
    for turns in range(max(1, int(math.log(max(1, rows / HELD), size) + 1e-9)), 0, -1):
        ranks = []
        for i, near in of.items():
            h = Hash(len(given[i][1]), turns, tables)
            tried, at = h.probes(_unit(given[i][1][None]), MOST_PROBES)[0], h.buckets(_unit(np.array(near)))
            for own in at:
                hit = tried == own[:, None]
                ranks.append(np.where(hit.any(1), hit.argmax(1), MOST_PROBES * 2).min() + 1)
        most = int(np.sort(ranks)[math.ceil(target * len(ranks)) - 1])
        if most <= MOST_PROBES or turns == 1:
            return turns, most
    return 1, 1


def _looked(nodes: DataFrame, queries: DataFrame, spare: int, turns: int, probes: int, tables: int, s: Scratch, name: str, every: bool = False) -> DataFrame:
    """(query, ids, score): for each query up to ``spare`` nodes, the nearest of those in the buckets it looks into. every: all buckets of one turn, whatever their number."""

    def placed(batches):
        for b in batches:
            out = np.empty(b.num_rows, object)
            for rows, x in matrices(b.column(1)):
                out[rows] = list(Hash(x.shape[1], turns, tables).buckets(_unit(x)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.int64()))], names=["node", "v", "ids", "buckets"])

    def looking(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = np.empty(part.num_rows, object)
                for rows, x in matrices(part.column(1)):
                    h = Hash(x.shape[1], turns, tables)
                    out[rows] = [r.tolist() for r in h.probes(_unit(x), 2 * h.size if every else probes)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(out), pa.list_(pa.list_(pa.int64())))], names=["node", "v", "buckets"])

    kind = f"array<{nodes.schema['v'].dataType.elementType.simpleString()}>"
    held = s.keep(nodes.select("node", "v", "ids").transform(arrow, placed, f"node string, v {kind}, ids array<long>, buckets array<long>"), f"{name}-held")
    sought = s.keep(queries.select("node", "v").transform(arrow, looking, f"node string, v {kind}, buckets array<array<long>>"), f"{name}-sought")
    key = ["width", "table", "bucket"]
    rows = held.select("node", "v", "ids", F.size("v").alias("width"), F.posexplode("buckets").alias("table", "bucket"))
    asks = sought.select("node", "v", F.size("v").alias("width"), F.posexplode("buckets").alias("table", "some")).select("node", "v", "width", "table", F.explode("some").alias("bucket"))
    # buckets beyond a piece, as (pieces of rows, pieces of queries); by the size of a piece they are MOST_LARGE at most on either side
    sides = []
    for df, column in ((rows, "down"), (asks, "across")):
        counted = df.groupBy(*key).agg(F.count("*").alias("n"))
        piece = max(PIECE, (df.count() if df is asks else held.count() * tables) // MOST_LARGE)
        sides.append(counted.where(F.col("n") > piece).select(*key, F.ceil(F.col("n") / piece).cast("int").alias(column)))
    large = s.keep(sides[0].join(sides[1], key, "full"), f"{name}-large")
    cut = lambda c: F.coalesce(F.col(c), F.lit(1))
    spread = lambda c: F.explode(F.sequence(F.lit(0), cut(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("node"), cut(c)).cast("int")
    rows = rows.join(F.broadcast(large), key, "left").select(*key, own("down").alias("x"), spread("across").alias("y"), F.lit(0).alias("kind"), "node", "v", "ids")
    asks = asks.join(F.broadcast(large), key, "left").select(*key, spread("down").alias("x"), "across", F.lit(1).alias("kind"), "node", "v").select(*key, "x", own("across").alias("y"), "kind", "node", "v", F.lit(None).cast("array<long>").alias("ids"))
    both = rows.unionByName(asks).repartition(*key, "x", "y").sortWithinPartitions(*key, "x", "y", "kind")

    def met(batches):
        now, kept = None, []

        def against(b: pa.RecordBatch):
            nonlocal kept
            if not kept:
                return None
            if len(kept) > 1 or not isinstance(kept[0], tuple):
                t = pa.Table.from_batches(kept).combine_chunks()
                x = np.asarray(t.column("v").chunk(0).flatten(), np.float64).reshape(t.num_rows, -1)
                ids = t.column("ids").chunk(0)
                least = pc.fill_null(pc.list_element(ids, 0), 2**63 - 1)
                kept = [(t.column("node").chunk(0), x, ids, np.asarray(least))]
            names, x, ids, least = kept[0]
            q = np.asarray(b.column(b.schema.get_field_index("v")).flatten(), np.float64).reshape(b.num_rows, -1)
            out = [nearest(q[i : i + 256], x, least, spare) for i in range(0, len(q), 256)]
            places, far = zip(*[p for o in out for p in o])
            which = np.repeat(np.arange(len(places)), [len(p) for p in places])
            at = pa.array(np.concatenate(places))
            return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")).take(pa.array(which)), names.take(at), ids.take(at), pa.array(np.concatenate(far))], names=["query", "node_id", "ids", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([np.asarray(b.column(i)) for i in range(6)], 1)
            for s_, e in zip(*(lambda c: (c[:-1], c[1:]))(np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, len(marks)])):
                cell, kind_ = tuple(marks[s_, :5]), marks[s_, 5]
                if cell != now:
                    now, kept = cell, []
                part = b.slice(s_, e - s_)
                if kind_ == 0:
                    kept.append(part)
                elif (out := against(part)) is not None:
                    yield out

    near = both.select(*key, "x", "y", "kind", "node", "v", "ids").transform(arrow, met, "query string, node_id string, ids array<long>, score double")
    one = near.groupBy("query", "node_id").agg(F.first("ids").alias("ids"), F.first("score").alias("score"))
    best = Window.partitionBy("query").orderBy("score", F.get("ids", F.lit(0)).asc_nulls_last(), "node_id")
    return s.keep(one.withColumn("at", F.row_number().over(best)).where(F.col("at") <= spare).select("query", "node_id", "ids", "score"), name)
