"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

The model is fitted here, in numpy, on generated sentences whose spans are known.
It reads windows of ``WIDTH`` code points that overlap by half. Its tags are
decided per document: at every code point the window in whose middle it lies
most decides, and runs of one tag are spans. A span must hold a digit or an @; so
only the windows that decide one, and those that a run with one reaches, are
decoded. The spans are those of decoding all windows.
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

#: Kinds in their order; the model's tags are "nothing" and these.
KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 64, 32
HIDDEN, EMBED = 16, 10
#: Generated training windows, passes over them, seed.
EXAMPLES, EPOCHS, SEED = 2400, 4, 11
#: A span that the model adds has this many code points at least.
SHORTEST = 7
#: Windows decoded at once.
BATCH = 512

_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches from one @ to the next: the name before it reaches back as far as it can."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    if _TRIGGER.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


# the model


def codes(text: str) -> np.ndarray:
    """A small code for every code point: digits, marks and letters by group."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(c, 128)]


_MARKS = "@.+-() _%:,;/\n"
_TABLE = np.zeros(129, np.int64)
for _i in range(128):
    _c = chr(_i)
    _TABLE[_i] = 1 if _c.isdigit() else 2 + _MARKS.index(_c) if _c in _MARKS else 17 if _c.islower() else 18 if _c.isupper() else 19 if _c.isspace() else 20
_TABLE[128] = 21
SYMBOLS = 22


def _sentence(r: random.Random) -> tuple[str, list[int]]:
    """A text and the tag of each of its code points."""
    word = lambda: "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(1, 10)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def email():
        name = r.choice([word(), word() + "." + word(), word() + number(2), number(2)])
        return name + r.choice(["@", "@", " @ ", "(at)@", "@"]) + word() + number(r.randint(0, 1)) + "." + r.choice(["com", "org", "example.net", "de"])

    def card():
        d = r.choice("3456") + number(14)
        d += next(x for x in "0123456789" if luhn(d + x))
        return r.choice([d, "-".join(d[i : i + 4] for i in range(0, 16, 4)), " ".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))])

    def phone():
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b} {c}", f"00{number(2)} {a} {b}{c}", f"{a}.{b}.{c}"])

    make = {1: email, 2: lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), 3: card, 4: phone}
    plain = [lambda: number(r.randint(1, 5)), lambda: f"{number(4)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"{number(2)}:{number(2)}", lambda: f"{number(1)}.{number(2)}", lambda: number(2) + "%", lambda: "@" + word(), lambda: f"({number(4)})", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(8, 40)))]
    text, tags = "", []
    while len(text) < WIDTH:
        x = r.random()
        kind = r.randint(1, 4) if x < 0.14 else 0
        part = make[kind]() if kind else r.choice(plain)() if x < 0.28 else word().capitalize() if x < 0.4 else word()
        gap = r.choice([" ", " ", " ", ", ", ". ", "\n", ": "])
        text, tags = text + part + gap, tags + [kind] * len(part) + [0] * len(gap)
    at = r.randint(0, len(text) - WIDTH)
    return text[at : at + WIDTH], tags[at : at + WIDTH]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, LSTM in both directions, a linear layer, CRF transitions."""

    def __init__(self, seed: int = SEED):
        r, tags = np.random.default_rng(seed), 1 + len(KINDS)
        init = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": r.normal(0, 0.5, (SYMBOLS, EMBED)), "O": init(2 * HIDDEN, tags), "o": np.zeros(tags), "T": np.eye(tags) * 2.0}
        for d in "fb":
            self.p |= {f"W{d}": init(EMBED + HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    def _lstm(self, x, d, keep=None):
        """x: (time, rows, EMBED), in the order of reading."""
        w, bias = self.p[f"W{d}"], self.p[f"c{d}"]
        pre = x @ w[:EMBED] + bias
        h = np.zeros((x.shape[1], HIDDEN))
        c, out = h, np.empty((len(x), x.shape[1], HIDDEN))
        for t in range(len(x)):
            z = pre[t] + h @ w[EMBED:]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            s = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, s))
            h = o * s
            out[t] = h
        return out

    def _lstm_back(self, x, keep, dout, d, grad):
        w = self.p[f"W{d}"]
        dh, dc, dx = np.zeros_like(dout[0]), np.zeros_like(dout[0]), np.empty_like(x)
        for t in range(len(x) - 1, -1, -1):
            h, before, i, f, o, g, s = keep[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], 1)
            grad[f"W{d}"][:EMBED] += x[t].T @ dz
            grad[f"W{d}"][EMBED:] += h.T @ dz
            grad[f"c{d}"] += dz.sum(0)
            dx[t], dh, dc = dz @ w[:EMBED].T, dz @ w[EMBED:].T, dc * f
        return dx

    def emissions(self, ids, keep=None):
        """(time, rows, tags) for ids (rows, time)."""
        x = self.p["E"][ids.T]
        kf, kb = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._lstm(x, "f", kf), self._lstm(x[::-1], "b", kb)[::-1]], 2)
        if keep is not None:
            keep += [x, kf, kb, both]
        return both @ self.p["O"] + self.p["o"]

    def loss(self, ids, tags):
        """The mean negative log likelihood of tag sequences, and its gradient."""
        keep: list = []
        e, trans = self.emissions(ids, keep), self.p["T"]
        x, kf, kb, both = keep
        n, rows, _ = e.shape
        y = tags.T
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        for t in range(1, n):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        at, row = np.arange(n)[:, None], np.arange(rows)[None, :]
        score = e[at, row, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
        de = np.exp(alpha + beta - z[None, :, None])
        de[at, row, y] -= 1
        pairs = np.exp(alpha[:-1][:, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        np.add.at(pairs, (y[:-1].ravel(), y[1:].ravel()), -1)
        de, grad = de / rows, {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["T"] = pairs / rows
        grad["O"], grad["o"] = np.einsum("trh,trk->hk", both, de), de.sum((0, 1))
        dboth = de @ self.p["O"].T
        dx = self._lstm_back(x, kf, dboth[:, :, :HIDDEN], "f", grad)
        dx = dx + self._lstm_back(x[::-1], kb, dboth[::-1, :, HIDDEN:], "b", grad)[::-1]
        np.add.at(grad["E"], ids.T.ravel(), dx.reshape(-1, EMBED))
        return (z - score).mean(), grad

    def decode(self, ids) -> np.ndarray:
        """The best tag sequence of each row."""
        e, trans = self.emissions(ids), self.p["T"]
        n, rows, k = e.shape
        v, back = e[0], np.zeros((n, rows, k), np.int64)
        for t in range(1, n):
            s = v[:, :, None] + trans
            back[t] = s.argmax(1)
            v = np.take_along_axis(s, back[t][:, None, :], 1)[:, 0] + e[t]
        out = np.empty((rows, n), np.int64)
        out[:, -1] = v.argmax(1)
        for t in range(n - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(rows), out[:, t]]
        return out


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(seed)
    made = [_sentence(r) for _ in range(n)]
    return np.stack([codes(t) for t, _ in made]), np.array([g for _, g in made])


@functools.lru_cache(maxsize=2)
def train(n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED, batch: int = 48, rate: float = 0.02) -> Tagger:
    """Fit a tagger by Adam; the same arguments give the same tagger."""
    model, (ids, tags), r = Tagger(seed), examples(n, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    step, steps = 0, epochs * (-(-n // batch))
    for _ in range(epochs):
        order = r.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            _, grad = model.loss(ids[own], tags[own])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            step += 1
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def owner(at: int) -> int:
    """The window that decides a code point: of the two it lies in, the one whose middle is nearer."""
    return at // STRIDE - (at >= STRIDE and at % STRIDE < STRIDE // 2)


def owned(window: int, length: int) -> tuple[int, int]:
    """The code points that a window decides."""
    return (window * STRIDE + STRIDE // 2 if window else 0), min(length, window * STRIDE + 3 * STRIDE // 2)


def runs(length: int, tags: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs of one tag over the code points that the given windows decide."""
    found: list[list[int]] = []
    for w in sorted(tags):
        s, e = owned(w, length)
        own = tags[w][s - w * STRIDE : e - w * STRIDE]
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(edges, edges[1:]):
            if own[a]:
                if found and found[-1][2] == s + a and found[-1][1] == own[a] - 1:
                    found[-1][2] = s + b
                else:
                    found.append([s + a, int(own[a]) - 1, s + b])
    return [tuple(r) for r in found]


def decided(texts: list[str], model: Tagger, every: bool = False) -> list[list[tuple[int, int, int]]]:
    """The runs of each text that hold a digit or an @ (and some others), as decoding every window gives them.

    First the windows that decide a digit or an @ are decoded, then, again and
    again, those that such a run reaches. every: all windows, for tests.
    """
    at = [[m.start() for m in _TRIGGER.finditer(t)] for t in texts]
    tags: list[dict[int, np.ndarray]] = [{} for _ in texts]
    new = [(i, w) for i, (t, ps) in enumerate(zip(texts, at)) for w in (range(owner(len(t) - 1) + 1 if t else 0) if every else sorted({owner(p) for p in ps}))]
    out: list[list] = [[] for _ in texts]
    while new:
        ids = [np.pad(codes(t := texts[i][w * STRIDE : w * STRIDE + WIDTH]), (0, WIDTH - len(t)), constant_values=19) for i, w in new]
        for k in range(0, len(ids), BATCH):
            for (i, w), g in zip(new[k : k + BATCH], model.decode(np.stack(ids[k : k + BATCH]))):
                tags[i][w] = g
        changed, new = sorted({i for i, _ in new}), []
        for i in changed:
            out[i], n = runs(len(texts[i]), tags[i]), len(texts[i])
            more = set()
            for s, _, e in out[i]:
                if (p := bisect.bisect_left(at[i], s)) < len(at[i]) and at[i][p] < e:
                    more |= {owner(x) for x in (s - 1, e) if 0 <= x < n}
            new += [(i, w) for w in sorted(more) if w not in tags[i]]
    return out


def learned(texts: list[str], known: list[list], model: Tagger, every: bool = False) -> list[list[tuple[int, int, int]]]:
    """The spans that the model adds to each text; none overlaps a base span."""
    out = []
    for t, found_runs, base_spans in zip(texts, decided(texts, model, every), known):
        found = []
        for s, k, e in found_runs:
            while s < e and not (t[s].isalnum() or t[s] in "+("):
                s += 1
            while e > s and not t[e - 1].isalnum():
                e -= 1
            part = t[s:e]
            digits = sum(c in "0123456789" for c in part)
            fits = ("@" in part, digits >= 4 and part.count(".") == 3, digits >= 13, 7 <= digits <= 15)[k]
            if e - s >= SHORTEST and fits and not any(s < y and x < e for x, _, y in base_spans):
                found.append((s, k, e))
        out.append(found)
    return out


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_spans, spans) for every row of docs.

    Counts and base_spans are of the fixed patterns; spans has what the model
    adds as well. Null texts are empty, repeated rows and null ids are kept, an
    empty table gives an empty result, and other columns aren't read. Whole
    texts are scanned.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    model = model or train()
    names = ["id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = [t.as_py() or "" for t in b.column(1).slice(at, 256)]
                known = [base(t) for t in texts]
                made = [(*(sum(k == i for _, k, _ in x) for i in range(4)), spell(x), spell(x + y)) for x, y in zip(known, learned(texts, known, model))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), *(pa.array([m[i] for m in made], pa.int64() if i < 4 else pa.string()) for i in range(6))], names=names)

    return docs.select(F.col(id_col).alias("id"), text_col).transform(arrow, run, f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_spans string, spans string")
