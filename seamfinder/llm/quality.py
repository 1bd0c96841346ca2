"""Quality rules: fixed rules on document statistics, then gradient-boosted trees over them.

The statistics come from one pass over whole texts. The trees are fitted here,
in numpy, on a bounded sample of labelled documents, with monotonic constraints
(more symbols, repeats, shouting never raise the score), and are flattened into
node arrays; scoring walks all trees for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow

SPACE = " \t\n\x0b\x0c\r"
#: Most labelled documents that the trees are fitted on: those with the smallest hash of their id.
SAMPLE = 20_000
WINDOW = 5
FEATURES = ("log_words", "word_length", "symbols", "repeats", "dup_lines", "capitals", "shouts", "distinct", "line_words", "digits")
#: -1: a larger value never raises the score.
MONOTONE = np.array([0, 0, -1, -1, -1, -1, -1, 0, 0, 0])
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Odd multipliers for the hash of a window; equal hashes are compared word by word.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SYMBOLS, _CAPITALS, _SHOUTS, _DIGITS, _BLANKS = (np.frombuffer(x, np.uint8) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"!?", b"0123456789", SPACE.encode()))


def repeated(words: list, window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for i in range(window):
        w += h[i : i + n] * _MIX[i % 5] + np.uint64(i)
        w ^= w >> np.uint64(29)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    found: dict[tuple, list] = {}
    for i in np.flatnonzero(hit).tolist():  # exact, should hashes of different windows meet
        found.setdefault(tuple(words[i : i + window]), []).append(i)
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for v in found.values() if len(v) > 1 for i in v], np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: str | None) -> tuple:
    """The base statistics and the features of a text; null is an empty text."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    of = lambda kinds: int(counts[kinds].sum())
    words = text.encode("utf-8", "surrogatepass").split()
    n, blanks, lines, dup = len(words), of(_BLANKS), 0, 0
    chars = len(text) - blanks
    seen = set()
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated(words)
    per, symbols = max(n, 1), of(_SYMBOLS)
    features = (np.log1p(n), chars / per, symbols / per, repeats / per, dup / max(lines, 1), of(_CAPITALS) / max(chars, 1), of(_SHOUTS) / per, len(set(words)) / per, n / max(lines, 1), of(_DIGITS) / max(chars, 1))
    return (n, chars, symbols, dup, repeats), tuple(float(x) for x in features)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the base statistics, features array<double>)."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        for b in batches:
            made = [statistics(t.as_py()) for t in b.column(1)]
            base = [pa.array([m[0][i] for m in made], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *base, pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["id", *BASE, "features"])

    return docs.select(F.col(id_col).alias("id"), text_col).transform(arrow, run, f"id {kind}, {', '.join(f'{x} long' for x in BASE)}, features array<double>")


@dataclass
class Trees:
    """Complete binary trees in heap order: node i has the children 2i + 1 and 2i + 2."""

    depth: int
    start: float
    feature: np.ndarray = field(repr=False)
    limit: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row of x."""
        if not len(self.feature) or not len(x):
            return np.full(len(x), self.start)
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.limit[trees, node])
        return self.start + self.value[trees, node].sum(1)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray = MONOTONE, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, smooth: float = 5.0) -> Trees:
    """Boosted trees on the logistic loss, split on histograms; a child's values stay within what its ancestors' constrained splits allow."""
    inner, every = 2**depth - 1, 2 ** (depth + 1) - 1
    p = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        return Trees(depth, start, np.zeros((0, every), int), np.zeros((0, every)), np.zeros((0, every)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    f, trees = np.full(len(y), start), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        feature, limit, value = np.zeros(every, int), np.full(every, np.inf), np.zeros(every)
        low, high, node = np.full(every, -np.inf), np.full(every, np.inf), np.zeros(len(y), int)
        value[0] = np.sum(g) / (np.sum(h) + smooth)
        for i in range(inner):
            at = np.flatnonzero(node == i)
            best, total_g, total_h = (1e-6, None), g[at].sum(), h[at].sum()
            for j, c in enumerate(cuts):
                if not len(c) or len(at) < 2:
                    continue
                gl = np.cumsum(np.bincount(code[at, j], g[at], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[at, j], h[at], len(c) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                left, right = (np.clip(a / (b + smooth), low[i], high[i]) for a, b in ((gl, hl), (gr, hr)))
                gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - total_g**2 / (total_h + smooth)
                gain[(hl < 1e-3) | (hr < 1e-3) | (monotone[j] * (right - left) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, c[k], left[k], right[k]))
            a, b = 2 * i + 1, 2 * i + 2
            low[a] = low[b] = low[i]
            high[a] = high[b] = high[i]
            if best[1] is None:  # everything goes left
                value[a] = value[b] = value[i]
                node[at] = a
                continue
            j, feature[i], limit[i] = best[1][0], best[1][0], best[1][1]
            value[a], value[b] = best[1][2:]
            middle = (value[a] + value[b]) / 2
            if monotone[j] < 0:
                low[a], high[b] = middle, middle
            elif monotone[j] > 0:
                high[a], low[b] = middle, middle
            node[at] = np.where(x[at, j] > limit[i], b, a)
        f = f + rate * value[node]
        trees.append((feature, limit, rate * value))
    return Trees(depth, start, *(np.stack(t) for t in zip(*trees)))


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on the labelled documents with the smallest hashes, ``sample`` at most; labels: (doc_id, quality), nulls don't count."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    rows = measured.join(known, measured.id == known.doc_id).select("id", "good", "features").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    return fit(np.array([r.features for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r.good > 0) for r in rows]))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """(id, the base statistics, base_failed, score, kept) for every row of docs.

    base_failed: fewer than 10 words, or over 20 in 100 of them in repeated
    windows. kept: the base rules hold and the trees give good quality a
    probability of ``threshold`` or more. Null and empty texts have no words
    and fail. Repeated rows are judged alike, null ids like others. Without
    labels of both kinds the base rules decide alone. An empty table gives an
    empty result; other columns aren't read.
    """
    s = scratch or Scratch(docs.sparkSession, "quality")
    measured = s.keep(measure(docs, id_col, text_col), "measured")
    trees = train(measured, labels, sample)
    bar = float(np.log(threshold / (1 - threshold)))
    if not len(trees.feature):
        bar = -np.inf

    def run(batches):
        for b in batches:
            x = np.asarray(b.column("features").flatten()).reshape(b.num_rows, len(FEATURES))
            scores = trees.score(x)
            n, repeats = (np.asarray(b.column(c)) for c in ("n_words", "n_repeat_words"))
            failed = (n < 10) | (100 * repeats > 20 * n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", *BASE)), pa.array(failed), pa.array(scores), pa.array(~failed & (scores >= bar))], names=["id", *BASE, "base_failed", "score", "kept"])

    kind = dict(measured.dtypes)["id"]
    return measured.transform(arrow, run, f"id {kind}, {', '.join(f'{x} long' for x in BASE)}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The trees are fitted on the labelled documents with the smallest hashes,
    ``sample`` at most; texts stay where they are and are judged in one pass.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("good")) \
        .orderBy(F.xxhash64("of"), "of").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), text_col).join(F.broadcast(known), F.col("id") == F.col("of"))  # ``sample`` rows at most
    found = measure(rows.select("id", "good", text_col), "good", text_col).collect()
    trees = fit(np.array([r.features for r in found]).reshape(len(found), len(FEATURES)), np.array([float(r.id > 0) for r in found]))
    bar = float(np.log(threshold / (1 - threshold))) if len(trees.feature) else -np.inf

    def run(batches):
        for b in batches:
            made = [statistics(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))]
            if made:
                scores = trees.score(np.array([m[1] for m in made]))
                yield b.filter(pa.array([m[0][0] >= 10 and 100 * m[0][4] <= 20 * m[0][0] and bool(x >= bar) for m, x in zip(made, scores)]))

    return docs.transform(arrow, run, docs.schema)
