"""Byte-level BPE by recursive DuckDB queries, one database a partition.

The distinct pieces of a slice of texts become token-position rows. A recursive
query joins neighbouring tokens to the merge table, contracts the leftmost pair
of least rank of every word, and goes on with the words that still have a pair,
until none has. Ordered aggregation reads ids and decoded bytes off the rows.

Texts are cut into words where the pattern always has a boundary (``words``). A
word is encoded once and held in a table of bounded size.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow
from .words import Pool, slices, spread

#: Words in a worker's table, about.
CACHE = 300_000
#: Bytes of text in a slice, and of its new pieces in one recursive query.
SLICE, QUERY_BYTES = 4 << 20, 100_000
#: Longer pieces (bytes) have positions of their own kind of work: they are contracted one by one from a heap of pairs.
LONG = 1024

QUERY = """
with recursive t(step, w, p, np, id, nx, k) as (
    select 0, w, p, np, id, nx, (rank::bigint << 16) | p from word_rows left join merges on pair = (id::bigint << 20) | nx
  union all (
    with best as (select w, min(k) as k, arg_min(np, k) as gone from t group by w having min(k) is not null),
    hit as (select t.w, (best.k & 65535)::int as spot, (best.k >> 16)::int as rank, best.gone, t.nx as gone_nx, t.np as gone_np
            from t join best on t.w = best.w and t.p = best.gone),
    moved as (select step + 1 as step, t.w, t.p, if(t.p = spot, gone_np, t.np) as np, if(t.p = spot, hit.rank, t.id) as id,
                     case when t.p = spot then gone_nx when t.np = spot then hit.rank else t.nx end as nx, k, (t.p = spot or t.np = spot) as changed
              from t join hit on t.w = hit.w where t.p <> gone)
    select step, w, p, np, id, nx, if(changed, (merges.rank::bigint << 16) | p, k)
    from moved left join merges on pair = if(changed, (id::bigint << 20) | nx, null)))
select w, list(id order by p) as ids, string_agg(hex, '' order by p) as bytes
from t join (select w, max(step) as step from t group by w) using (w, step) join tokens using (id)
group by w order by w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Encodes texts; holds the merge table and the table of words of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # no spill to the worker's own disk: a query's rows are bounded by QUERY_BYTES
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        # every way to cut a token into two
        pair, rank = array("q"), array("i")
        for b, r in ranks.items():
            for i in range(1, len(b)):
                if (x := ranks.get(b[:i])) is not None and (y := ranks.get(b[i:])) is not None:
                    pair.append(x << 20 | y)
                    rank.append(r)
        self._load("merges", pa.table({"pair": np.frombuffer(pair, np.int64), "rank": np.frombuffer(rank, np.int32)}))
        by_id = {r: b for b, r in ranks.items()}
        top = max(by_id) + 1
        self.tokens, self.known = pa.array([by_id.get(i, b"") for i in range(top)], pa.binary()), pa.array(list(ranks), pa.binary())
        self._load("tokens", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([b.hex() for b in ranks])}))
        self.known_id = np.array(list(ranks.values()), np.int32)
        self.digits = pa.array([b"%d," % i for i in range(top)], pa.binary())
        self.ranks = ranks
        self.pool = Pool(self._learn, CACHE)

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(ids, how many each has, the bytes they decode to) of binary words."""
        n = np.asarray(pc.binary_length(words)).astype(np.int64)
        data = np.frombuffer(b"".join(words.to_numpy(zero_copy_only=False)), np.uint8)
        p = (np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        ids, last = self.byte[data], np.cumsum(n) - 1
        nx, np_ = np.append(ids[1:], -1).astype(np.int32), p + 1
        nx[last] = np_[last] = -1
        self.db.register("word_rows", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), n), "p": p, "np": np_.astype(np.int32), "id": ids, "nx": nx}))
        got = self.db.sql(QUERY).to_arrow_table().combine_chunks()
        self.db.unregister("word_rows")
        ids = got["ids"].combine_chunks()
        return np.asarray(ids.flatten()), np.diff(np.asarray(ids.offsets)).astype(np.int64), pa.array(map(bytes.fromhex, got["bytes"].to_pylist()), pa.binary())

    def long(self, word: bytes) -> list[int]:
        """The ids of one word of any length, in n log n."""
        ids, ranks, tokens = [int(self.byte[b]) for b in word], self.ranks, self.tokens.to_pylist()
        nxt, prev = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        pair = lambda i: ranks.get(tokens[ids[i]] + tokens[ids[nxt[i]]]) if nxt[i] >= 0 else None
        heap = [(r, i) for i in range(len(ids)) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or pair(i) != r:
                continue
            j = nxt[i]
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for x in (prev[i], i):
                if x >= 0 and (q := pair(x)) is not None:
                    heapq.heappush(heap, (q, x))
        return [i for i in ids if i >= 0]

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(ids, how many each has, the bytes they decode to) of distinct binary pieces."""
        found = pc.index_in(pieces, value_set=self.known)
        whole = np.flatnonzero(np.asarray(pc.is_valid(found)))
        size = np.array(pc.binary_length(pieces))
        size[whole] = 0
        far, rest = np.flatnonzero(size > LONG), np.flatnonzero((size > 0) & (size <= LONG))
        ids, lengths, raw, order = [self.known_id[np.asarray(found.drop_null())]], [np.ones(len(whole), np.int64)], [pieces.take(pa.array(whole))], [whole, rest, far]
        part = np.cumsum(size[rest]) // QUERY_BYTES
        for own in np.split(rest, np.flatnonzero(np.diff(part)) + 1) if len(rest) else []:
            for x, y in zip((ids, lengths, raw), self.words(pieces.take(pa.array(own)))):
                x.append(y)
        for i in far.tolist():
            ids.append(np.array(self.long(pieces[i].as_py()), np.int32))
            lengths.append([len(ids[-1])])
            raw.append(pa.array([b"".join(self.tokens.take(pa.array(ids[-1])).to_pylist())], pa.binary()))
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate(order)] = np.arange(len(pieces))
        lengths = np.concatenate(lengths).astype(np.int64)
        ends = np.cumsum(lengths)
        return spread(np.concatenate(ids), (ends - lengths)[place], lengths[place]), lengths[place], pa.concat_arrays(raw).take(pa.array(place))

    def _learn(self, letters: pa.Array, others: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        split = [self.pattern.findall(c) for c in others]
        every = pa.concat_arrays([letters, pa.array([p.encode("utf-8", "surrogatepass") for ps in split for p in ps], pa.binary()).cast(pa.string())]).cast(pa.binary()).dictionary_encode()
        ids, lengths, raw = self.pieces(every.dictionary)
        at = np.asarray(every.indices).astype(np.int64)
        ends = np.cumsum(lengths)
        last = len(letters) + np.cumsum([len(ps) for ps in split], dtype=np.int64)  # the pieces of a word end here
        last = np.concatenate([np.arange(1, len(letters) + 1), last])
        total = np.append(0, np.cumsum(lengths[at]))[last]
        return spread(ids, (ends - lengths)[at], lengths[at]), np.diff(total, prepend=0), joined(raw.take(pa.array(at)), last)

    def encode(self, texts: pa.Array):
        """(ids, ids joined by commas, decoded bytes) of each text; null is empty."""
        rows, ends = self.pool.slice(texts)
        ids, of_rows = self.pool.gather(rows)
        at = np.append(0, of_rows)[ends]
        csv, raw = joined(self.digits.take(pa.array(ids)), at), joined(self.pool.more.take(pa.array(rows)), ends)
        for i, c, r in zip(np.split(ids, at[:-1]), csv, raw):
            yield i, c.as_py()[:-1], r.as_py()


def joined(parts: pa.Array, ends: np.ndarray) -> pa.Array:
    """Binary parts put together: an entry for each of ends, the parts from the end before to it."""
    offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(offsets[0], offsets[ends]).astype(np.int32)), parts.buffers()[2] or pa.py_buffer(b"")])


@functools.lru_cache(maxsize=1)
def coder_of(vocabulary: str, pattern: str) -> Coder:
    """One for all tasks of a worker."""
    return Coder(load_ranks(vocabulary), pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>, decoded]) for every row of docs.

    vocabulary: a file of base64 tokens and ranks that every executor has.
    Null texts are empty: no ids, nothing decoded. Texts aren't cut short,
    repeated rows and null ids are kept, an empty table gives an empty result,
    and other columns aren't read.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches):
        coder = coder_of(vocabulary, pattern)
        for b in batches:
            for at, texts in slices(b.column(1), SLICE):
                made = [(len(ids), hashlib.sha256(csv).hexdigest(), hashlib.sha256(raw).hexdigest(), *((ids, raw.decode("utf-8", "replace")) if with_ids else ())) for ids, csv, raw in coder.encode(texts)]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *(pa.array([m[i] for m in made], kinds[i]) for i in range(len(names) - 1))], names=names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).alias("id"), text_col).transform(arrow, run, schema)
