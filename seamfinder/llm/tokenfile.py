"""Token-id files, coded by Simple-8b.

A 64-bit word has a selector in its top 4 bits and as many ids of one width in
the other 60 as the selector says. Selector 0 escapes: the whole next word is
one id. Blocks of 128 ids start at words of their own, whose offsets are stored,
so that all blocks are packed, and unpacked, at once in numpy.

A file is a sequence of frames, each with whole documents in ascending order of
doc_id: magic, counts, the documents' ids and lengths, the blocks' offsets, the
words. Files are named by their place in the order.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow, filesystem
from .words import Pool, slices

#: Ids in a word and bits of each, for the selectors from 1 on.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 128
MAGIC = 0x38424D53
#: Ids in a frame, about; a document is never divided.
FRAME = 1 << 18
#: Words in a worker's table, about.
CACHE = 400_000
#: Bytes of texts encoded at a time, and words of letters that go to the library in one call.
SLICE, JOINED = 4 << 20, 1 << 10

_COUNT = np.array([1, *(k for k, _ in SELECTORS)], np.int64)
_SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)

#: How byte-level vocabularies spell the bytes that have no character of their own (in Latin 1): as those from 256 on.
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, the first word of each block) of ids (uint64)."""
    ids = np.asarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    padded = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = _widths(padded)
    # most[k]: the width of the widest of k ids from here on
    most, selector = {1: bits}, np.where(bits <= 60, len(SELECTORS), 0).astype(np.uint8)[:, :BLOCK]
    for s, (k, width) in sorted(enumerate(SELECTORS, 1), key=lambda x: x[1][0]):
        if k == 1:
            continue
        a = max(j for j in most if j <= k)
        b, m = k - a, most[a]
        while b:
            part = max(j for j in most if j <= b)
            m = _widest(m, most[part], k - b)
            b -= part
        most[k] = m
        selector[most[k][:, :BLOCK] <= width] = s
    pos = np.zeros(blocks, np.int64)
    end = np.full(blocks, BLOCK)
    end[-1] = n - BLOCK * (blocks - 1)
    every, taken = np.arange(blocks), []
    while (open_ := pos < end).any():
        taken.append(np.where(open_, pos, -1))
        pos = np.where(open_, pos + _COUNT[selector[every, np.minimum(pos, BLOCK - 1)]], pos)
    taken = np.stack(taken, 1)
    block, step = np.nonzero(taken >= 0)
    start = taken[block, step]
    s = selector[block, start]
    size = 1 + (s == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for i, (k, width) in enumerate(SELECTORS, 1):
        if len(own := np.flatnonzero(s == i)):
            word = np.full(len(own), np.uint64(i) << np.uint64(60), np.uint64)
            for j in range(k):
                word |= padded[block[own], start[own] + j] << np.uint64(j * width)
            words[place[own]] = word
    if len(own := np.flatnonzero(s == 0)):
        words[place[own] + 1] = padded[block[own], start[own]]
    return words, place[np.searchsorted(block, np.arange(blocks))].astype(np.uint32)


def _widths(x: np.ndarray) -> np.ndarray:
    """The bits that each of x (uint64) takes."""
    if (most := int(x.max())) < len(_SMALL):
        return _SMALL[x]
    bits = np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)  # exact below 2**53
    if most >> 32:
        high = x >> np.uint64(32)
        bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, bits).astype(np.uint8)
    return bits


def _widest(m: np.ndarray, other: np.ndarray, shift: int) -> np.ndarray:
    """max(m[i], other[i + shift]); past the end nothing is wider."""
    out = m.copy()
    moved = other[:, shift : shift + m.shape[1]]
    np.maximum(out[:, : moved.shape[1]], moved, out=out[:, : moved.shape[1]])
    return out


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of words."""
    if not n:
        return np.zeros(0, np.uint64)
    head = np.ones(len(words), bool)
    s = (words >> np.uint64(60)).astype(np.int64)
    escaped = np.flatnonzero(s == 0)
    if len(escaped):  # a raw word looks like anything: go through the escapes in order
        skip = -1
        for i in escaped.tolist():
            if i != skip:
                head[i + 1], skip = False, i + 1
        s = np.where(head, s, 0)
    kept = np.flatnonzero(head)
    k = _COUNT[s[kept]]
    block = np.searchsorted(offsets, kept, "right") - 1
    before = np.cumsum(k) - k
    first = before[np.searchsorted(kept, offsets)]
    start = before - first[block]
    out = np.zeros((len(offsets), BLOCK + 60), np.uint64)
    for i, (count, width) in enumerate(SELECTORS, 1):
        if len(own := np.flatnonzero(s[kept] == i)):
            w, mask = words[kept[own]], np.uint64((1 << width) - 1)
            for j in range(count):
                out[block[own], start[own] + j] = (w >> np.uint64(j * width)) & mask
    if len(own := np.flatnonzero(s[kept] == 0)):
        out[block[own], start[own]] = words[kept[own] + 1]
    return out[:, :BLOCK].reshape(-1)[:n]


def frame(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = np.array([MAGIC, len(doc_ids), len(ids), len(offsets), len(words)], "<u8")
    return b"".join((head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(lengths, "<i8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def frames(stream) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of each frame of a binary stream."""

    def take(n: int, kind: str) -> np.ndarray:
        raw = stream.read(n * np.dtype(kind).itemsize)
        if len(raw) != n * np.dtype(kind).itemsize:
            raise ValueError("the file ends within a frame")
        return np.frombuffer(raw, kind)

    while raw := stream.read(40):
        if len(raw) != 40 or (head := np.frombuffer(raw, "<u8"))[0] != MAGIC:
            raise ValueError("not a frame")
        docs, n, blocks, words = map(int, head[1:])
        doc_ids, known, lengths = take(docs, "<i8"), take(docs, "u1"), take(docs, "<i8")
        offsets = take(blocks, "<u4")
        yield [int(d) if k else None for d, k in zip(doc_ids, known)], lengths, unpack(take(words, "<u8"), offsets, n)


class Encoder:
    """Whole texts through the tokenizers library, each distinct word once while the table of words holds it.

    Words of Latin letters, being one piece, go to the library's model as they
    are, many in a call; their ids are told apart by the bytes of their tokens.
    All others, and whole texts that hold an added token such as
    ``<|endoftext|>``, go through the library unchanged.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library's own only wait for it
        from tokenizers import Tokenizer

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise ValueError("a normalizer could reach over words")
        self.bare.pre_tokenizer = None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(added) or None
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # byte-level: a character a byte
        self.pool = Pool(self._learn, CACHE)

    def _learn(self, letters: pa.Array, others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        mapped = [w.replace(" ", _BYTES[32]) if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in letters.to_numpy(zero_copy_only=False)]
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(mapped), JOINED):
            own = mapped[at : at + JOINED]
            (found,) = self.bare.encode_batch_fast([own], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            ends, want = np.cumsum(self.width[ids[-1]]), np.cumsum([len(w) for w in own])
            last = np.searchsorted(ends, want)
            if (ends[last] != want).any():
                raise ValueError("a token reaches over words")
            lengths.append(np.diff(last, prepend=-1))
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        ids.append(np.array([i for own in rest for i in own], np.int32))
        lengths.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        return np.concatenate(ids), np.concatenate(lengths)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        ids, ends = self.pool.encode(texts)
        out = np.split(ids, ends[:-1])
        if self.added:
            for i in np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(texts, self.added), False))).tolist():
                out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, end: int | None, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", name: str = "tokens") -> DataFrame:
    """Write docs in ascending order of id, nulls first; returns the list of files (part, file, docs, ids, start)."""
    folder = scratch.path(name)
    tail = np.array([] if end is None else [end], np.int32)

    def run(batches):
        from pyspark import TaskContext

        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        coder = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        file, docs_n, ids_n = f"part-{part:06d}-{uuid.uuid4().hex}", 0, 0
        held: list = [[], [], []]

        def flush():
            out.write(frame(held[0], held[1], np.concatenate(held[2])))
            for x in held:
                x.clear()

        out, size = None, 0
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, texts in slices(b.column(1), SLICE):
                out = out or fs.open_output_stream(f"{at}/{file}", compression=None)
                for key, ids in zip(keys[first : first + len(texts)], coder.encode(texts)):
                    held[0].append(key)
                    held[1].append(len(ids) + len(tail))
                    held[2] += (ids, tail)
                    size += held[1][-1]
                    docs_n, ids_n = docs_n + 1, ids_n + held[1][-1]
                    if size >= FRAME:
                        flush()
                        size = 0
        if out is not None:
            if held[0]:
                flush()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file]), pa.array([docs_n], pa.int64()), pa.array([ids_n], pa.int64())], names=["part", "file", "docs", "ids"])

    placed = docs.select(F.col(id_col).cast("long").alias("id"), text_col).repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    files = scratch.keep(placed.transform(arrow, run, "part int, file string, docs long, ids long"), f"{name}-list")
    # one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def scan(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of the documents in listed files; start counts the ids before in all files."""

    def run(batches):
        fs, at = filesystem(folder)
        for b in batches:
            for file, start, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen = 0
                with fs.open_input_stream(f"{at}/{file}", compression=None) as stream:
                    for doc_ids, lengths, ids in frames(stream):
                        raw, ends = ids.astype("<u4"), np.cumsum(lengths)
                        starts = ends - lengths
                        cols = [pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(lengths), pa.array([zlib.crc32(raw[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())], pa.int64())]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(raw.astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                        start, seen = start + int(lengths.sum()), seen + len(doc_ids)
                if seen != count:
                    raise ValueError(f"{file}: {seen} of {count} documents")

    n = max(1, files.count())
    return files.select("file", "start", "docs").repartition(n).transform(arrow, run, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end: int | None = 2, with_ids: bool = False, scratch: Scratch | None = None, **columns) -> DataFrame:
    """Encode and write docs, and read the files back.

    Null texts are empty: just the end id. Rows with a null id come first,
    repeated ids lie beside each other in any order. An empty table gives an
    empty result; other columns aren't read.
    """
    s = scratch or Scratch(docs.sparkSession, "tokens")
    return scan(write(docs, tokenizer, end, s, **columns), s.path("tokens"), with_ids)
