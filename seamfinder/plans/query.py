"""The boolean query language, compiled to Columns.

``a b`` is a OR b; AND, + and - bind like the space, left to right; only an
explicit OR binds looser. +t must be there, -t must not; if any +t is there at
all, plain terms only score. "a b" is exact; field:t is read as t.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    keywords: tuple[str, ...]
    required: bool = False
    excluded: bool = False
    exact: bool = False
    field: str | None = None
    written: str = ""  # as the query has it


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


Expr = Term | And | Or
_TOKEN = re.compile(r'\s*(?:(?P<mark>[+\-():])|"(?P<quoted>[^"]*)"|(?P<word>[\w.][\w.\-]*))', re.U)


class QueryError(ValueError):
    pass


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at] == '"':
                raise QueryError("a quotation that doesn't end")
            at += 1
            continue
        at = m.end()
        if m["mark"]:
            out.append((m["mark"], m["mark"]))
        elif m["quoted"] is not None:
            out.append(("quoted", m["quoted"]))
        else:
            out.append((m["word"].upper(), m["word"]) if m["word"].upper() in ("AND", "OR") else ("word", m["word"]))
    return out


class _Parser:
    def __init__(self, tokens, analyze):
        self.tokens, self.at, self.analyze = tokens, 0, analyze

    def peek(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise QueryError("the query ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Expr:
        left = self.row()
        while self.peek() == "OR":
            self.take()
            left = Or(left, self.row())
        return left

    def row(self) -> Expr:
        left = self.factor()
        while (p := self.peek()) not in (None, "OR", ")"):
            if p == "AND":
                self.take()
                left = And(left, self.factor())
            elif p in "+-":
                left = And(left, self.factor())
            else:
                left = Or(left, self.factor())
        return left

    def factor(self) -> Expr:
        if self.peek() == "(":
            self.take()
            inner = self.either()
            if self.take()[0] != ")":
                raise QueryError("a parenthesis isn't closed")
            return inner
        mark = self.take()[0] if self.peek() in ("+", "-") else ""
        kind, value = self.take()
        field = None
        if kind == "word" and self.peek() == ":":
            self.take()
            field, (kind, value) = value, self.take()
        if kind not in ("word", "quoted"):
            raise QueryError(f"a term is missing before {value!r}")
        exact = kind == "quoted"
        keywords = (value.lower(),) if exact or mark == "-" else tuple(self.analyze(value))  # what is excluded stays as it is written
        return Term(keywords, mark == "+", mark == "-", exact, field, value)


def parse(text: str, analyze: Callable[[str], list[str]], exact: bool = False) -> Expr:
    """analyze gives a term's keywords. Queries that don't parse are taken as words that all must match."""
    if exact:
        return Term((text.lower(),), exact=True, written=text)
    try:
        p = _Parser(_lex(text), analyze)
        found = p.either()
        if p.peek() is not None:
            raise QueryError("words are left over")
        return found
    except QueryError:
        return Term(tuple(w for raw in re.findall(r"\w+", text) for w in analyze(raw)), written=text)


def leaves(e: Expr) -> list[Term]:
    return [e] if isinstance(e, Term) else leaves(e.left) + leaves(e.right)


def keywords(e: Expr) -> list[str]:
    """Sorted keywords; a keyword's place is its index."""
    return sorted({k for t in leaves(e) for k in t.keywords})


def compile_match(e: Expr, has: Callable[[str, bool], Column], files: bool = False) -> Column:
    """A boolean Column, never null. has(keyword, exact) says whether one occurs; files: exclusions hold at the level of files."""
    all_terms = leaves(e)
    required = [t for t in all_terms if t.required and not t.excluded]
    yes, no = F.lit(True), F.lit(False)

    def every(t: Term) -> Column:
        out = yes if t.keywords else no
        for k in t.keywords:
            out = out & has(k, t.exact)
        return out

    def none(t: Term) -> Column:
        out = yes
        for k in t.keywords:
            out = out & ~has(k, t.exact)
        return out

    def walk(x: Expr) -> Column:
        if isinstance(x, Term):
            if x.excluded:
                return yes if files else none(x)
            return every(x) if x.required or not required else yes
        a, b = walk(x.left), walk(x.right)
        return a & b if isinstance(x, And) else a | b

    out = walk(e)
    for t in required:
        out = out & every(t)
    if any(not t.excluded for t in all_terms):
        some = no
        for t in all_terms:
            for k in t.keywords:
                some = some | has(k, t.exact)
        out = out & some
    return F.coalesce(out, no)


def evaluate(e: Expr, present: set[str], files: bool = False) -> bool:
    """The same rules over a set, for tests and small driver-side checks."""
    all_terms = leaves(e)
    required = [t for t in all_terms if t.required and not t.excluded]
    every = lambda t: bool(t.keywords) and all(k in present for k in t.keywords)

    def walk(x):
        if isinstance(x, Term):
            if x.excluded:
                return files or not any(k in present for k in x.keywords)
            return every(x) if x.required or not required else True
        return (walk(x.left) and walk(x.right)) if isinstance(x, And) else (walk(x.left) or walk(x.right))

    out = walk(e) and all(every(t) for t in required)
    return bool(out and (any(k in present for t in all_terms for k in t.keywords) or all(t.excluded for t in all_terms)))


def compile_score(e: Expr, score: Callable[[str], Column]) -> Column:
    """A double Column; null where a rule of the scored tree fails."""
    if isinstance(e, Term):
        t = F.lit(0.0)
        for k in e.keywords:
            t = t + score(k)
        if e.excluded:
            return F.when(t > 0, None).otherwise(0.0)
        return F.when(t > 0, t) if e.required else t
    a, b = compile_score(e.left, score), compile_score(e.right, score)
    if isinstance(e, And):
        return a + b
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
