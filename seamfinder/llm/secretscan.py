"""Secret scans: fixed patterns, and credentials in several parts linked within a scope.

A part that means little alone (an account name, an endpoint, a high-entropy
token) is reported only where a complementary part lies near it in the same
scope: tokens beside an identifier or an endpoint, identifiers and endpoints
beside a secret. The link is a join of intervals: the scope of every part
against the parts of complementary roles, over sorted starts and the running
maximum of ends. A scope is a whole paragraph, as blank lines divide a text.
Parts may be of any length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

#: The base kinds in their order, then those of the linked parts.
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|(?:access_?)?key_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?([A-Za-z0-9@._+-]{3,})""", re.I | re.A)
_ENDPOINT = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>|]{4,}", re.A)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Intervals:
    """Which of many intervals (start, end) touch another one."""

    def __init__(self, of: list[tuple[int, int]]):
        of = sorted(of)
        self.starts, self.ends = [s for s, _ in of], list(accumulate((e for _, e in of), max))

    def touch(self, start: int, end: int) -> bool:
        """Some interval has its start below end and its end above start."""
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def linked(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak parts that complementary parts confirm; none overlaps a base span."""
    taken = Intervals([(s, e) for s, _, e in known])
    weak_ids = [(m.start(), m.end()) for m in _IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    ends = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    ids = [(s, e) for s, k, e in known if k == 1]
    if not (weak_ids or ends or ids):
        return []  # no part that a token could belong to, and none that needs a secret
    free = lambda spans: [x for x in spans if not taken.touch(*x)]
    weak_ids, ends = free(weak_ids), free(ends)
    other = Intervals(weak_ids + ends)
    tokens = [x for x in free([m.span() for m in _TOKEN.finditer(text)]) if not other.touch(*x) and _mixed(text[slice(*x)])]
    strong = [(s, e) for s, k, e in known if k != 1]
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]

    def confirmed(parts, by):
        index = Intervals(by)

        def near(s):
            i = bisect_right(breaks, s)
            low, high = breaks[i - 1] if i else 0, breaks[i] if i < len(breaks) else len(text)
            return index.touch(low, high)

        return [x for x in parts if near(x[0])]

    places = ids + weak_ids + ends
    secrets = strong + tokens
    return [(s, k, e) for k, parts, by in ((3, weak_ids, secrets), (4, tokens, places), (5, ends, secrets)) for s, e in confirmed(parts, by)]


def spell(spans: list[tuple[int, int, int]], kinds=KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_spans, spans) for every row; spans as kind:start:end in code points.

    Null texts are empty and have no spans; repeated rows and null ids are kept
    as they are, an empty table gives an empty result, other columns aren't
    read. Whole texts are scanned, each in time linear in its length but for
    the sorting of its spans.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        for b in batches:
            made = []
            for t in b.column(1):
                text = t.as_py() or ""
                known = base(text)
                made.append((*(sum(k == i for _, k, _ in known) for i in range(3)), spell(known), spell(known + linked(text, known))))
            cols = [pa.array([m[i] for m in made], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return docs.select(F.col(id_col).alias("id"), text_col).transform(arrow, run, f"id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of a text replaced by <SECRET>; null texts stay null, columns stay as they are."""

    def run(batches):
        at = None
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = []
            for t in b.column(at):
                text = t.as_py()
                if text:
                    known = base(text)
                    spans, out, end = sorted(known + linked(text, known)), [], 0
                    for s, _, e in spans:
                        if s >= end:
                            out += [text[end:s], "<SECRET>"]
                        end = max(end, e)
                    text = "".join(out) + text[end:] if spans else text
                texts.append(text)
            yield b.set_column(at, text_col, pa.array(texts, b.schema.field(at).type))

    return docs.transform(arrow, run, docs.schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
