"""Substring dedup by level-wise doubling: windows of 4, 7 and 13 words, for 13.

The first level looks at short windows. Of these, every text gives only those
that are the least (by hash) within some window of full length: what two texts
share at full length, they share in that choice too, at every level. Windows that
a single text has are done with. What others have is extended to twice its length
(the full length at most), level after level, until no candidates survive or the
full length is reached. What survives there is removed from all documents but
those with the smallest id.

A text counts once however many documents have it: the other documents with it
lose everything, and take no part in the levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow

LENGTH = 13
#: Windows of the first level have this many words at most.
SHORTEST = 4
#: Odd multipliers of the window hashes: first level, last level (two, for 128 bits).
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rolled(h: np.ndarray, k: int, m: np.uint64) -> np.ndarray:
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= m
        out += h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= _M2
    return out ^ out >> np.uint64(29)


def levels(length: int) -> list[int]:
    """The lengths of windows, each twice the one before at most, the first at most SHORTEST."""
    out = [length]
    while out[0] > SHORTEST or len(out) == 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def chosen(h: np.ndarray, length: int, short: int) -> np.ndarray:
    """For each full window of the word hashes h, the hash of the least short window in it.

    48 bits: where hashes meet by chance, more survives a level, never less.
    """
    g = _rolled(h, short, _M1) >> np.uint64(16)
    return np.lib.stride_tricks.sliding_window_view(g, length - short + 1).min(axis=1)


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _kept(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _profile(docs: DataFrame, length: int) -> DataFrame:
    """(id, n, digest, full, windows): the word count, digests of the words and the chosen windows of the first level."""
    short = levels(length)[0]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, made = b.column(0).slice(at, 256), []
                for t in b.column(1).slice(at, 256):
                    words = words_of(t.as_py())
                    windows = np.unique(chosen(_hashes(words), length, short)).view(np.int64) if len(words) >= length else np.zeros(0, np.int64)
                    made.append((len(words), digest(words), _kept(words), windows))
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names=["id", "n", "digest", "full", "windows"])

    return docs.transform(arrow, run, "id long, n long, digest binary, full string, windows array<long>")


def _extend(docs: DataFrame, length: int, before: int, now: int) -> DataFrame:
    """What surviving windows of ``before`` words become at ``now`` words; docs: (id, text, digest, windows).

    Short of the full length: (digest, windows), chosen again. At full length:
    (id, digest, w1, w2, starts), every full window around a surviving one, in 96
    bits. A text whose digest isn't the wanted one (its id is repeated with
    another text) gives nothing.
    """
    whole = now == length

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, made = b.slice(at, 64), []
                for i, text, wanted, windows in zip(*(c for c in part.columns)):
                    words, wanted = words_of(text.as_py()), wanted.as_py()
                    if digest(words) != wanted:
                        continue
                    h = _hashes(words)
                    hit = np.flatnonzero(np.isin(chosen(h, length, before), np.array(windows.as_py(), np.int64).view(np.uint64)))
                    if whole:
                        made.append((i.as_py(), wanted, _rolled(h, length, _M2)[hit].view(np.int64), (_rolled(h, length, _M3)[hit] >> np.uint64(32)).astype(np.uint32).view(np.int32), hit))
                    else:
                        made.append((wanted, np.unique(chosen(h, length, now)[hit]).view(np.int64)))
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2) if whole else (pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["id", "digest", "w1", "w2", "starts"] if whole else ["digest", "windows"])

    return docs.select("id", "text", "digest", "windows").transform(arrow, run, "id long, digest binary, w1 array<long>, w2 array<int>, starts array<int>" if whole else "digest binary, windows array<long>")


def covered(n: int, starts, length: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    starts = np.unique(np.asarray(starts, np.int64))
    edges[starts] += 1
    edges[starts + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) for every row of docs.

    Removed is each word in a window of ``length`` words that also starts in a
    document with a smaller id; windows are those of the input. kept: the text
    that is left (null where nothing was removed), words joined by a space.

    Null and empty texts have no words. Rows that repeat an id remove nothing
    from each other; rows with a null id are compared with none. An empty
    table gives an empty result; other columns aren't read.
    """
    s = scratch or Scratch(docs.sparkSession, "substring")
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = s.keep(_profile(given, length), "profile")

    first = seen.groupBy("digest").agg(F.min("id").alias("least"))
    role = s.keep(seen.select("id", "digest").distinct().join(first, "digest").select("id", "digest", (F.col("id") > F.col("least")).alias("copy")), "role")

    # 64 bits of a digest stand for its text (of two texts that share them, a passage that nobody else has would stay)
    key = F.xxhash64("digest").alias("key")
    reps = role.where("not copy").select("id", "digest", key)
    own, steps, wide = seen.where("id is not null").select(key, "windows"), levels(length), None
    base = s.keep(seen.select("id", "n", "digest", "full"), "base")
    for step, (before, now) in enumerate(zip(steps, steps[1:])):
        each = own.select("key", F.explode("windows").alias("h"))
        shared = each.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z").select("h")
        shared = s.keep(shared, f"shared-{step}")  # a table of its own, so that hot keys of the join can be split
        candidates = s.keep(each.join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("windows")), f"candidates-{step}")
        s.drop("profile" if not step else f"own-{step - 1}", f"shared-{step}")
        s.release()
        if candidates.isEmpty():
            break
        wanted = reps.join(candidates, "key").select(F.col("id").alias("rep"), "digest", "windows")
        longer = _extend(given.join(wanted, given.id == wanted.rep), length, before, now)
        if now == length:
            wide = s.keep(longer.withColumn("row", F.monotonically_increasing_id()), "wide")
        else:
            own = s.keep(longer.select(key, "windows"), f"own-{step}")
        s.drop(f"candidates-{step}")
        s.release()
    late = None
    if wide is not None:
        windows = wide.select("id", "row", F.explode(F.arrays_zip("w1", "w2", "starts")).alias("x")).select("id", "row", "x.w1", "x.w2", "x.starts")
        least = windows.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("w1", "w2", "least")
        least = s.keep(least, "least")
        late = windows.join(least, ["w1", "w2"]).where("id > least").groupBy("row").agg(F.collect_set("starts").alias("late"))
        late = late.withColumnRenamed("row", "at").join(wide.select("id", "digest", "row"), F.col("at") == F.col("row")).select(F.col("id").alias("rep"), "digest", "late")
        late = s.keep(late, "late")
        s.drop("wide", "least")
        s.release()

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, made = b.slice(at, 256), []
                for i, d, text, late in zip(*(c for c in part.columns)):
                    words = words_of(text.as_py())
                    if digest(words) != d.as_py():
                        continue
                    gone = covered(len(words), late.as_py(), length)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                    made.append((i.as_py(), d.as_py(), int(gone.sum()), _kept(kept), b" ".join(kept).decode("utf-8", "replace") if with_text else None))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["of", "was", "removed", "sha", "kept"])

    fields = "of long, was binary, removed long, sha string, kept string"
    if late is None:
        lost = docs.sparkSession.createDataFrame([], fields)
    else:
        lost = given.join(late, given.id == late.rep).select("id", "digest", "text", "late")
        lost = s.keep(lost.transform(arrow, cut, fields).dropDuplicates(["of", "was"]), "lost")
        s.release()

    copy = role.where("copy").select(F.col("id").alias("c"), F.col("digest").alias("cd"), F.lit(True).alias("copy"))
    out = base.join(copy, (F.col("id") == F.col("c")) & (F.col("digest") == F.col("cd")), "left").join(lost, (F.col("id") == F.col("of")) & (F.col("digest") == F.col("was")), "left")
    whole = F.col("copy") & (F.col("n") >= length)
    cols = [
        "id", F.col("n").alias("n_words"), F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "full")).alias("kept_sha256"),
    ]
    return out.select(*cols, *([F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []))
