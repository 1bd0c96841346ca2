"""What a query's terms look like in a text: words, stems and parts in one automaton, run over whole files."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analyzer
from ..plans.query import Expr, keywords, leaves
from ..sources import corpus
from .lexer import Lines

#: Stems that end so are also looked for without the ending, as the words they stand for may have another one.
_ENDINGS = ("bl", "e", "i", "y")


def root(stem: str) -> str:
    """What a stem and nearly all words with that stem begin with; four letters at least."""
    for end in _ENDINGS:
        if stem.endswith(end) and len(stem) > len(end) + 3:
            return stem[: -len(end)] + ("b" if end == "bl" else "")
    return stem


def patterns(e: Expr, lattice=None) -> dict[str, tuple[str, ...]]:
    """For each keyword of a query the texts that a line with it has, shortest first, without those that hold another: the stem, words as they are written, parts of compounds.

    What is exact or excluded stands for itself.
    """
    out: dict[str, set[str]] = {}
    for t in leaves(e):
        written = {} if t.exact or t.excluded else analyzer.forms(t.written, lattice)
        for k in t.keywords:
            out.setdefault(k, set()).update([k] if t.exact or t.excluded else [k, *written.get(k, ())])
    return {k: tuple(p for p in sorted(v, key=lambda x: (len(x), x)) if p and not any(q != p and q in p for q in v)) for k, v in out.items()}


def hints(e: Expr, lattice=None) -> dict[str, tuple[str, ...]]:
    """Patterns and, where the keyword is a stem, its root: a text without any has no word with that stem, but for a few irregular ones whose forms share less (dying, die)."""
    plain = {k for t in leaves(e) if t.exact or t.excluded for k in t.keywords}
    return {k: v if k in plain or any(p in root(k) for p in v) else (*(p for p in v if root(k) not in p), root(k)) for k, v in patterns(e, lattice).items()}


def contains(text: Column, some: tuple[str, ...]) -> Column:
    """Whether a text has one of these, whatever the case; null has none."""
    low = F.lower(text)
    return F.coalesce(functools.reduce(lambda a, b: a | b, [low.contains(x) for x in some], F.lit(False)), F.lit(False))


class Matcher:
    """All patterns and roots of a query's keywords in one automaton; a keyword's index is its place in ``terms``.

    A line that has only a keyword's root counts if one of its words has the
    keyword as a token.
    """

    def __init__(self, e: Expr, terms: list[str], lattice=None):
        import ahocorasick

        self.terms, self.automaton = terms, ahocorasick.Automaton()
        sure, every = patterns(e, lattice), hints(e, lattice)
        for i, t in enumerate(terms):
            for h in dict.fromkeys((*sure.get(t, ()), *every.get(t, ()))):
                self.automaton.add_word(h, (*self.automaton.get(h, ()), (i, h in sure[t])))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def lines(self, content: str, lattice=None) -> dict[int, set[int]]:
        """For each line of LINE_BYTES at most the indices of the keywords it has."""
        out: dict[int, set[int]] = {}
        if not self.some:
            return out
        low = content.lower()
        at, maybe = Lines(low), {}  # lower case may be longer, but has the same lines
        for end, which in self.automaton.iter(low):
            line = at.of(end)
            for i, sure in which:
                (out if sure else maybe).setdefault(line, set()).add(i)
        if not out and not maybe:
            return out
        lines = content.split("\n")
        for line, which in maybe.items():
            rest = which - out.get(line, set())
            if rest and (has := {i for i in rest if self.terms[i] in analyzer.forms(lines[line - 1], lattice)}):
                out.setdefault(line, set()).update(has)
        return {n: x for n, x in out.items() if len(lines[n - 1]) <= corpus.LINE_BYTES // 4 or len(lines[n - 1].encode("utf-8", "surrogatepass")) <= corpus.LINE_BYTES}


def line_terms(files: DataFrame, e: Expr) -> DataFrame:
    """(path, line_no, term): lines of files(path, content) that have a keyword of the query, in one pass over each file; term is the keyword's index.

    Null texts have no lines; repeated files give theirs each time; an empty
    table gives an empty result, and other columns aren't read.
    """
    matcher = Matcher(e, keywords(e))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n, i) for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, which in sorted(matcher.lines(text or "").items()) for i in sorted(which)]
            paths, lines, which = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lines, pa.int32()), pa.array(which, pa.int32())], names=["path", "line_no", "term"])

    return files.select("path", "content").mapInArrow(run, "path string, line_no int, term int")
