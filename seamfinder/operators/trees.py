"""Patterns of code matched on trees of brackets and statements.

A text is a list of siblings: tokens, and groups of brackets with siblings of
their own. Statements are stretches of siblings. A pattern is such a list too, in
which $X stands for a node (or, before what comes next, for as few as it takes
that are one expression) and $$$X for any number of siblings; the same name stands for the same tokens
wherever it is, in other groups too. Groups match as a whole. What fails for a
place of the pattern, a place of the text and the names bound so far isn't tried
again.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

from .lexer import lex
from .segment import _FAMILY, _GOES_ON, declared, language_of

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\w\s]")
_PATTERN = re.compile(r"\s+|\$\$\$(?:[A-Z_]\w*)?|\$[A-Z_]\w*|[A-Za-z_]\w*|\d[\w.]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[^\w\s]")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_LINED = {"js", "go", "swift", "python", "ruby"}
#: Words that an expression may begin with, or have before an operand.
_PREFIX = frozenset("new await not typeof mut ref in is lambda and or async yield as instanceof void delete dyn unsafe move".split())
#: What goes on with a statement after a group in braces.
_AFTER = frozenset("else catch finally while except elif rescue ensure . , ) ] ? : = + - * / & | < >".split())


class Node(NamedTuple):
    """A token, or a group with its siblings; places are offsets, and the places of its first token and after its last."""

    text: str
    start: int
    end: int
    children: tuple | None
    first: int
    after: int


class Tree(NamedTuple):
    """A list of siblings, for each the place after its statement, and for each text the places of its tokens."""

    nodes: list[Node]
    stops: list[int]
    places: dict[str, list[int]]


def _grouped(tokens: list[tuple[str, int, int]]) -> list[Node]:
    """Tokens as a tree of groups; a closing bracket without its opening one is a token, an open one closes at the end of what it is in."""
    stack: list[tuple[int, list[Node]]] = [(-1, [])]
    open_ = dict.fromkeys(_PAIRS, 0)

    def close(end: int, after: int) -> None:
        k, nodes = stack.pop()
        t, s, _ = tokens[k]
        open_[t] -= 1
        stack[-1][1].append(Node(t, s, end, tuple(nodes), k, after))

    for k, (t, s, e) in enumerate(tokens):
        opening = next((o for o, c in _PAIRS.items() if c == t), None)
        if t in _PAIRS:
            stack.append((k, []))
            open_[t] += 1
        elif opening and open_[opening]:
            while tokens[stack[-1][0]][0] != opening:
                close(s, k)
            close(e, k + 1)
        else:
            stack[-1][1].append(Node(t, s, e, None, k, k + 1))
    while len(stack) > 1:
        close(tokens[-1][2], len(tokens))
    return stack[0][1]


def _tokens(content: str, code: str, strings: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Words, numbers, signs and strings of a text, without its comments."""
    found = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(code)]
    pieces = [(content[s:e].strip(), s, e) for s, e in strings if content[s:e].strip()]
    return sorted(found + pieces, key=lambda t: t[1])


def _stops(nodes: list[Node], content: str, family: str, inside: str) -> list[int]:
    """For each sibling the place after its statement."""
    out, start = [0] * len(nodes), 0
    for i, n in enumerate(nodes):
        over = i + 1 == len(nodes) or n.text == ";" or inside in ("(", "[") and n.text == ","
        if not over:
            nxt, between = nodes[i + 1], content[n.end : nodes[i + 1].start]
            if n.text == "{" and n.children is not None:
                over = nxt.text not in _AFTER and nxt.text not in _PAIRS and nxt.text != ";" and ("\n" in between or family not in _LINED)
            elif "\n" in between and family in _LINED and inside not in ("(", "["):
                over = nxt.text not in _AFTER and nxt.text != "{" and (not _GOES_ON.search(n.text) or family == "python" and n.text == ":")
        if over:
            out[start : i + 1] = [i + 1] * (i + 1 - start)
            start = i + 1
    return out


def compiled(pattern: str) -> list:
    """A pattern as a list of siblings: (kind, text or siblings), kinds being token, one, many and group."""
    raw = [t for t in _PATTERN.findall(pattern) if not t.isspace()]
    stack: list[list] = [[]]
    opened: list[str] = []
    for t in raw:
        if t in _PAIRS:
            stack.append([])
            opened.append(t)
        elif t in _PAIRS.values():
            if not opened or _PAIRS[opened[-1]] != t:
                raise ValueError(f"a pattern has {t!r} without its other half")
            inner = stack.pop()
            stack[-1].append(("group", opened.pop(), inner))
        else:
            stack[-1].append(("many", t) if t.startswith("$$$") else ("one", t) if t.startswith("$") else ("token", t))
    if opened:
        raise ValueError(f"a pattern has {opened[-1]!r} without its other half")
    if not stack[0]:
        raise ValueError("a pattern needs something to match")
    return stack[0]


def _names(pattern: list) -> list[str]:
    return [n for kind, what, *inner in pattern for n in (_names(inner[0]) if inner else [what] if kind != "token" else [])]


class _Search:
    """One pattern on one text."""

    def __init__(self, content: str, family: str, tokens: list[tuple[str, int, int]], ends: list[tuple[int, int]], pattern: list):
        self.content, self.family, self.tokens, self.ends, self.pattern = content, family, tokens, ends, pattern
        self.starts = [s for s, _ in ends]
        self.failed: set = set()
        self.trees: dict[int, Tree] = {}
        every = _names(pattern)
        self.bound = {n for n in every if every.count(n) > 1 and n not in ("$_", "$$$", "$$$_")}  # other names bind nothing

    def tree(self, nodes, inside: str) -> Tree:
        """Siblings with their statements; in languages without braces a declaration is a statement, to its end."""
        found = self.trees.get(id(nodes))
        if found is None:
            stops, places = _stops(nodes, self.content, self.family, inside), {}
            for i, n in enumerate(nodes):
                if n.children is None:
                    places.setdefault(n.text, []).append(i)
            if self.family in ("python", "ruby") and not inside:
                at = [n.start for n in nodes]
                for i, n in enumerate(nodes):
                    k = bisect.bisect_left(self.starts, n.start)
                    if k < len(self.ends) and self.starts[k] == n.start:
                        stop = bisect.bisect_left(at, self.ends[k][1])
                        for j in range(i, stops[i]):  # the head, which the rest belongs to
                            stops[j] = max(stops[j], stop)
            found = self.trees[id(nodes)] = Tree(nodes, stops, places)
        return found

    def go(self, p: list, i: int, tree: Tree, at: int, names: tuple, whole: bool, first: int):
        """(place after the match, names), or None: p[i:] from a place on; whole: the siblings must be used up."""
        key = (id(p), i, id(tree.nodes), at, names, -1 if whole else first)
        if key in self.failed:
            return None
        out = self._go(p, i, tree, at, names, whole, first)
        if out is None:
            self.failed.add(key)
        return out

    def _bind(self, name: str, nodes: list[Node], at: int, to: int, names: tuple):
        if name not in self.bound:
            return names
        words = " ".join(t for t, _, _ in self.tokens[nodes[at].first : nodes[to - 1].after]) if to > at else ""
        for n, w in names:
            if n == name:
                return names if w == words else None
        return tuple(sorted((*names, (name, words))))

    def _go(self, p, i, tree, at, names, whole, first):
        nodes, n = tree.nodes, len(tree.nodes)
        if i == len(p):
            return (at, names) if not whole or at == n else None
        kind, what, *inner = p[i]
        if kind == "token":
            if at < n and nodes[at].children is None and nodes[at].text == what:
                return self.go(p, i + 1, tree, at + 1, names, whole, first)
            return None
        if kind == "group":
            if at >= n or nodes[at].children is None or nodes[at].text != what:
                return None
            found = self.go(inner[0], 0, self.tree(nodes[at].children, what), 0, names, True, 0)
            return found and self.go(p, i + 1, tree, at + 1, found[1], whole, first)
        last = i + 1 == len(p)
        # a run doesn't leave the statement that the match began in
        limit = n if whole else max(at, tree.stops[first] if first < n else at)
        if kind == "one":
            over = self._expression(nodes, at, limit) if not last or whole else min(at + 1, limit)
            if last and whole:
                ends = [over] if over == n > at else []
            else:
                ends = self._ends(p, i, tree, at + 1, over)
        elif last:  # the rest
            ends = [limit]
        else:
            ends = self._ends(p, i, tree, at, limit)
        for to in ends:
            bound = self._bind(what, nodes, at, to, names)
            if bound is not None and (out := self.go(p, i + 1, tree, to, bound, whole, first)):
                return out
        return None

    @staticmethod
    def _expression(nodes: list[Node], at: int, limit: int) -> int:
        """How far nodes are one expression: up to a comma or semicolon, and to where an operand follows another."""
        operand = lambda x: x.children is not None or x.text[0].isalnum() or x.text[0] in "_$\"'`"
        for k in range(at, limit):
            x = nodes[k]
            if x.children is None and (x.text in (",", ";") or k > at and operand(x) and operand(nodes[k - 1]) and nodes[k - 1].text not in _PREFIX and x.text not in _PREFIX):
                return k
        return limit

    @staticmethod
    def _ends(p: list, i: int, tree: Tree, low: int, high: int):
        """Where a run may end, nearest first: before the token that comes next in the pattern, if one does."""
        if i + 1 < len(p) and p[i + 1][0] == "token":
            found = tree.places.get(p[i + 1][1], [])
            return iter(found[bisect.bisect_left(found, low) : bisect.bisect_right(found, high)])
        return range(low, high + 1)

    def every(self, nodes: list[Node]) -> list[tuple[int, int]]:
        out, left = [], [(nodes, "")]
        while left:
            siblings, inside = left.pop()
            tree = self.tree(siblings, inside)
            for at, node in enumerate(siblings):
                found = self.go(self.pattern, 0, tree, at, (), False, at)
                if found and found[0] > at:
                    out.append((node.start, siblings[found[0] - 1].end))
                if node.children:
                    left.append((node.children, node.text))
        return sorted(out)


def matches(content: str, ext: str | None, pattern: list) -> list[tuple[int, int]]:
    """(start, end) offsets of a compiled pattern's matches, in order; one at most from each place."""
    language = language_of(ext)
    if language is None or not content:
        return []
    family = _FAMILY[language]
    lexed = lex(content, family)
    tokens = _tokens(content, lexed.code, lexed.strings)
    if not tokens:
        return []
    ends = [(x[0], x[1]) for x in declared(lexed, family)] if family in ("python", "ruby") else []
    return _Search(content, family, tokens, ends, pattern).every(_grouped(tokens))
