"""A Merkle manifest of a dataset: a proof for every row that it is under one root.

Rows are leaves, a tree a source, three nodes a run; the sources' roots are the
leaves of one more tree. Leaves are dealt out in blocks of 3^h consecutive ones
of a source, however many blocks a source has, and each block is reduced to one
node where it is. What is left is small: the driver builds the top of the tree
from it, and sends out the path from each block to the root (position and
siblings, level by level). With it, the tasks that hold the blocks finish every
row's proof and fold every row up to the root. Where more nodes are left than the
driver takes, they are reduced by further rounds of blocks first.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify, unhexlify

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow

#: Nodes of a run, levels of a block, and nodes that the driver builds the top of the tree from at most.
RUN, LEVELS, TOP = 3, 7, 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A way up: for each level the place in the run and the run's others.
WAYS = "tree string, pos long, subroot binary, root binary, way array<struct<at:int,others:array<binary>>>"


def H(parts: list[bytes]) -> bytes:
    """The digest of digests; all are lower-case hex."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(*fields: Column) -> Column:
    """Hex SHA-256 of fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    parts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts]), 256)


def reduce(nodes: list[bytes], levels: int | None = None) -> list[list[bytes]]:
    """The levels of a tree from its leaves up: until one node is left, or so many levels."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([H(below[i : i + RUN]) for i in range(0, len(below), RUN)])
    return out


def path(levels: list[list[bytes]], at: int) -> list[tuple[int, list[bytes]]]:
    """For each level but the last the place of a leaf's ancestor in its run, and the run's others."""
    out = []
    for nodes in levels[:-1]:
        first, own = at // RUN * RUN, at % RUN
        run = nodes[first : first + RUN]
        out.append((own, run[:own] + run[own + 1 :]))
        at //= RUN
    return out


def fold(node: bytes, way) -> bytes:
    """What a node gives at the end of its way up."""
    for at, others in way:
        node = H([*others[:at], node, *others[at:]])
    return node


def height(n: int) -> int:
    """Levels above n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // RUN), out + 1
    return out


def positions(df: DataFrame, order: list[str], s: Scratch, name: str) -> DataFrame:
    """df with ``pos``, a row's place from 0 in its tree (in that order), and ``size``, the tree's rows.

    Rows are dealt by ranges of the whole order, so that a large tree is in
    many tasks, and counted there; only a row for each tree and task is summed up.
    """
    dealt = df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("mid", F.monotonically_increasing_id())
    dealt = s.keep(dealt.withColumn("task", F.shiftright("mid", 33)), name)
    per = dealt.groupBy(F.col("tree").alias("t"), F.col("task").alias("k")).agg(F.count("*").alias("n"), F.min("mid").alias("low"))
    w = Window.partitionBy("t")
    before = F.coalesce(F.sum("n").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("t", "k", (before - F.col("low")).alias("shift"), F.sum("n").over(w).alias("size"))
    return dealt.join(per, (F.col("tree") == F.col("t")) & (F.col("task") == F.col("k"))).withColumn("pos", F.col("mid") + F.col("shift")).drop("t", "k", "task", "mid", "shift")


def manifest(docs: DataFrame, levels: int = LEVELS, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs.

    Leaves of a source (null and the empty one are two) ascend by doc_id, null
    ids first, and by their digests where ids are equal; repeated rows are
    leaves each. Rows whose id has an even crc32 are tampered with: their text
    loses its newlines, and folded_root is what their proof gives then. Null
    ids, null texts and texts without a newline stay as they are. A tree of one
    leaf is that leaf, and the proof of a table's only row has no siblings. An
    empty table gives an empty result; columns beside doc_id, source, lang,
    n_chars and text aren't read.

    levels, top: of a block, and of nodes that the driver takes at most; the
    results are the same.
    """
    s = scratch or Scratch(docs.sparkSession, "merkle")
    given = {c: F.col(c) for c in FIELDS}
    even = F.coalesce(F.crc32(given["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = leaf(*(given | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values())
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("tree")  # in the order of sources, null first
    rows = docs.select(tree, F.col("doc_id").cast("long").alias("id"), F.unhex(leaf(*given.values())).alias("node"), F.when(even & F.contains("text", F.lit("\n")), F.unhex(tampered)).alias("changed"))
    blocks = _blocks(positions(rows, ["id", "node"], s, "leaves"), levels, s, "blocks", {"id": "long", "changed": "binary"})

    def finished(batches):
        for b in batches:
            for i in range(b.num_rows):
                size, nodes, ids, changes, subroot, root, way = (c[i].as_py() for c in b.columns)
                own = reduce(list(map(hexlify, nodes)), min(levels, height(size)))
                above = [(w["at"], list(map(hexlify, w["others"]))) for w in way]
                tail, root, subroot, out = b"".join(x for _, others in above for x in others), hexlify(root), hexlify(subroot), []
                for at, (node, change) in enumerate(zip(own[0], changes)):
                    near = path(own, at)
                    proof = hashlib.sha256(b"".join(x for _, others in near for x in others) + tail).hexdigest()
                    folded = fold(fold(hexlify(change) if change else node, near), above)
                    out.append((node.decode(), proof, folded.decode(), folded == root))
                leaves, proofs, folds, fine = map(list, zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(leaves), pa.array([subroot.decode()] * len(out)), pa.array([root.decode()] * len(out)), pa.array(proofs), pa.array(folds), pa.array(fine)],
                                                 names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    ways = _ways(_tops(blocks, levels), levels, top, s, 1)
    return blocks.join(ways, ["tree", "pos"]).select("size", "nodes", "id", "changed", "subroot", "root", "way") \
        .transform(arrow, finished, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _blocks(nodes: DataFrame, levels: int, s: Scratch, name: str, more: dict[str, str]) -> DataFrame:
    """A row for each block of consecutive nodes of a tree: (tree, pos, size, nodes, *more, top).

    nodes: (tree, pos, size, node, *more). pos is the block's place in its tree
    from then on, size still the number of the tree's nodes; top is the node that
    the block is reduced to. A tree that is smaller than a block is reduced to
    its root.
    """
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / RUN**levels)).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")

    def packed(batches):
        now, held = None, []

        def made():
            own, *rest = map(list, zip(*held))
            top = reduce(list(map(hexlify, own)), min(levels, height(now[2])))[-1][0]
            lists = [pa.array([own], pa.list_(pa.binary())), *[pa.array([r], pa.list_(kinds[k])) for r, k in zip(rest, more.values())]]
            return pa.RecordBatch.from_arrays([*[pa.array([x]) for x in now], *lists, pa.array([unhexlify(top)])], names=["tree", "pos", "size", "nodes", *more, "top"])

        for b in batches:
            for tree, block, size, *row in zip(*(c.to_pylist() for c in b.columns)):
                if now != (tree, block, size):
                    if held:
                        yield made()
                    now, held = (tree, block, size), []
                held.append(row)
        if held:
            yield made()

    fields = "".join(f"{c} array<{k}>, " for c, k in more.items())
    return s.keep(dealt.select("tree", "block", "size", "node", *more).transform(arrow, packed, f"tree string, pos long, size long, nodes array<binary>, {fields}top binary"), name)


def _tops(blocks: DataFrame, levels: int) -> DataFrame:
    """The nodes that blocks leave: (tree, pos, size, node)."""
    return blocks.select("tree", "pos", F.ceil(F.col("size") / RUN**levels).alias("size"), F.col("top").alias("node"))


def _ways(nodes: DataFrame, levels: int, most: int, s: Scratch, step: int) -> DataFrame:
    """(tree, pos, subroot, root, way) for nodes (tree, pos, size, node), with the way from each up to the root of all trees."""
    if nodes.count() <= most:
        return F.broadcast(_top(nodes))  # ``most`` rows at most
    single = nodes.where("size > 1").isEmpty()
    if single:  # roots of trees are the leaves of one tree
        given = positions(nodes.select(F.lit("").alias("tree"), "node", F.col("tree").alias("of")), ["of"], s, f"roots-{step}")
    else:  # one more round of blocks; a tree that is done is a block of one node
        given = nodes.withColumn("of", F.col("tree"))
    blocks = _blocks(given, levels, s, f"blocks-{step}", {"of": "string"})

    def longer(batches):
        for b in batches:
            for i in range(b.num_rows):
                size, block, nodes, of, subroot, root, way = (c[i].as_py() for c in b.columns)
                own = reduce(list(map(hexlify, nodes)), min(levels, height(size)))
                ways = [[{"at": a, "others": list(map(unhexlify, o))} for a, o in path(own, at)] + way for at in range(len(nodes))]
                at = [0] * len(nodes) if single else [block * RUN**levels + k for k in range(len(nodes))]
                roots = nodes if single else [subroot] * len(nodes)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(at, pa.int64()), pa.array(roots, pa.binary()), pa.array([root] * len(nodes), pa.binary()), pa.array(ways, pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.binary()))])))],
                                                 names=["tree", "pos", "subroot", "root", "way"])

    above = _ways(_tops(blocks, levels), levels, most, s, step + 1)
    return s.keep(blocks.join(above, ["tree", "pos"]).select("size", "pos", "nodes", "of", "subroot", "root", "way").transform(arrow, longer, WAYS), f"ways-{step}")


def _top(nodes: DataFrame) -> DataFrame:
    """The top of the tree, built on the driver from a bounded number of nodes, as the ways that lead up from each."""
    by: dict[str, list[bytes]] = {}
    for r in sorted(nodes.select("tree", "pos", "node").collect(), key=lambda r: (r.tree.encode(), r.pos)):
        by.setdefault(r.tree, []).append(hexlify(r.node))
    trees = {t: reduce(x) for t, x in by.items()}
    upper = reduce([x[-1][0] for x in trees.values()] or [b""])
    rows = []
    for k, (t, x) in enumerate(trees.items()):
        for at in range(len(x[0])):
            way = [{"at": a, "others": list(map(unhexlify, others))} for a, others in [*path(x, at), *path(upper, k)]]
            rows.append((t, at, unhexlify(x[-1][0]), unhexlify(upper[-1][0]), way))
    return nodes.sparkSession.createDataFrame(rows, WAYS)
