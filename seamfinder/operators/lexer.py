"""What of a source text is code: strings, comments and the like as spaces, by a stack of modes.

Text inside a template, an interpolated string or a nested comment may hold code
again, or more of itself, so places are found by modes on a stack: each knows
what can begin in it and what ends it. What is left keeps its place. Branches of
the preprocessor after the first one are blanked too, as they repeat heads.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple


class Lexed(NamedTuple):
    """code: the text with everything else as spaces; comments, and what else is blanked (strings, whole or in pieces): (start, end) offsets, in order."""

    code: str
    comments: list[tuple[int, int]]
    strings: list[tuple[int, int]]


_BLANK = re.compile(r"[^\n]")
_LINE, _OPEN = r"(?P<line>//[^\n]*)", r"(?P<open>/\*)"
_DOUBLE, _SINGLE = r"(?P<s1>\"(?:\\.|[^\"\\\n])*\"?)", r"(?P<s2>'(?:\\.|[^'\\\n])*')"
_TRIPLE = r"(?P<s3>\"\"\"(?:\\.|(?!\"\"\").)*(?:\"\"\"|\Z))"
#: What begins something in a language's code. Groups: line and open (comments), s1-s9 (whole strings), quote (a string that may hold code), slash (a regular expression, or not), here (a heredoc), brace.
_STARTS = {
    "js": rf"{_LINE}|{_OPEN}|{_DOUBLE}|{_SINGLE}|(?P<quote>`)|(?P<slash>/)|(?P<brace>[{{}}])",
    "rust": rf"{_LINE}|{_OPEN}|(?P<s4>\bb?r(?P<h>#*)\".*?(?:\"(?P=h)|\Z))|(?P<s1>\"(?:\\.|[^\"\\])*\"?)|(?P<s2>b?'(?:\\[^\n']+|\\'|[^'\\\n])')",
    "go": rf"{_LINE}|{_OPEN}|{_DOUBLE}|{_SINGLE}|(?P<s3>`[^`]*`?)",
    "java": rf"{_LINE}|{_OPEN}|{_TRIPLE}|{_DOUBLE}|{_SINGLE}",
    "c": rf"{_LINE}|{_OPEN}|(?P<s4>\bR\"(?P<h>[^()\s\\]{{0,16}})\(.*?(?:\)(?P=h)\"|\Z))|{_DOUBLE}|(?:(?<=\bu8)|(?<!\d)){_SINGLE}",
    "csharp": rf"{_LINE}|{_OPEN}|{_TRIPLE}|(?P<s4>(?:\$?@|@\$)\"(?:\"\"|[^\"])*\"?)|(?P<quote>\$\")|{_DOUBLE}|{_SINGLE}|(?P<brace>[{{}}])",
    "php": rf"{_LINE}|(?P<hash>\#(?!\[)[^\n]*)|{_OPEN}|(?P<s1>\"(?:\\.|[^\"\\])*\"?)|(?P<s2>'(?:\\.|[^'\\])*'?)|(?P<here><<<[ \t]*(?P<q>[\"']?)(?P<tag>[A-Za-z_]\w*)(?P=q)[^\n]*\n)|(?P<end>\?>)",
    "swift": rf"{_LINE}|{_OPEN}|{_TRIPLE}|(?P<s4>\#+\".*?(?:\"\#+|\Z))|(?P<quote>\")|(?P<brace>[()])",
    "python": r"(?P<line>\#[^\n]*)|(?P<s3>\"\"\"(?:\\.|(?!\"\"\").)*(?:\"\"\"|\Z)|'''(?:\\.|(?!''').)*(?:'''|\Z))|(?P<s1>\"(?:\\.|[^\"\\\n])*\"?)|(?P<s2>'(?:\\.|[^'\\\n])*'?)",
    "ruby": r"(?P<block>^=begin\b.*?(?:^=end\b[^\n]*|\Z))|(?P<over>^__END__$.*)|(?P<line>\#[^\n]*)|(?P<here><<[~-]?(?P<q>[\"'`]?)(?P<tag>[A-Z_]\w*)(?P=q))|(?P<quote>[\"`])|(?P<s2>'(?:\\.|[^'\\])*'?)|(?P<slash>/)|(?P<percent>%[qQwWiIrx]?(?P<p>[\[({<|!/]))|(?P<brace>[{}])",
}
_STARTS = {k: re.compile(v, re.S | re.M) for k, v in _STARTS.items()}
#: Inside a string that may hold code: what ends it, what begins code, what closes that code again.
_INSIDE = {
    ("js", "`"): (re.compile(r"\\.|`|\$\{", re.S), "`", "${", "{", "}"),
    ("csharp", '$"'): (re.compile(r"\\.|\"|\{\{|\{|\n", re.S), '"', "{", "{", "}"),
    ("swift", '"'): (re.compile(r"\\\(|\\.|\"|\n", re.S), '"', "\\(", "(", ")"),
    ("ruby", '"'): (re.compile(r"\\.|\"|#\{", re.S), '"', "#{", "{", "}"),
    ("ruby", "`"): (re.compile(r"\\.|`|#\{", re.S), "`", "#{", "{", "}"),
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new instanceof do else yield await if unless while until when and or not then elsif puts".split())
_NESTED = {"rust", "swift"}
_COMMENT_EDGE = re.compile(r"/\*|\*/")
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w+)((?:\\\r?\n|[^\n])*)", re.M)
_PREPROCESSED = {"c": None, "csharp": frozenset("if elif else endif region endregion define undef pragma nullable line error warning".split())}
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _is_regex(text: str, at: int, family: str) -> bool:
    """Whether a slash begins a regular expression, by what stands before it."""
    i = at - 1
    while i >= 0 and text[i] in " \t\r\n":
        i -= 1
    if i < 0:
        return True
    c = text[i]
    if c.isalnum() or c in "_$":
        j = i
        while j >= 0 and (text[j].isalnum() or text[j] in "_$"):
            j -= 1
        word = text[j + 1 : i + 1]
        return word in _BEFORE_REGEX and (j < 0 or text[j] != ".") or family == "ruby" and i < at - 1 and text[at + 1 : at + 2] not in (" ", "=") and word.isidentifier() and word[0].islower()
    if c == "<":  # the end of an element
        return False
    return c not in ")]\"'`" and not (c == "}" and i == at - 1)


def lex(text: str, family: str) -> Lexed:
    """The code of a text and where its comments are."""
    spans: list[tuple[int, int]] = []
    comments: list[tuple[int, int]] = []
    starts, size, pos = _STARTS[family], len(text), 0
    modes: list[list] = []  # strings with code in them: [kind of string, how deep the code's brackets are], innermost last
    heredocs: list[str] = []

    def blank(a: int, b: int) -> None:
        if b > a:
            spans.append((a, b))

    if family == "php":  # outside of its tags a file is text
        first = re.search(r"<\?(?:php|=)?", text)
        pos = first.end() if first else size if "<" in text[:1] else 0
        blank(0, pos)

    def inside(kind: str, at: int) -> int:
        """Go on in a string until it ends or code begins."""
        pattern, end, code, *_ = _INSIDE[family, kind]
        while m := pattern.search(text, at):
            blank(at, m.end())
            at = m.end()
            if m[0] == end or m[0] == "\n":
                modes.pop()
                return at
            if m[0] == code:
                modes[-1][1] = 1
                return at
        blank(at, size)
        modes.pop()
        return size

    def bodies(at: int) -> int:
        """The heredocs that the line before has begun, one after the other."""
        for tag in heredocs:
            over = re.compile(rf"^[ \t]*{tag}\b", re.M).search(text, at)
            blank(at, over.end() if over else size)
            at = over.end() if over else size
        heredocs.clear()
        return at

    while pos < size and (m := starts.search(text, pos)):
        kind, at, to = m.lastgroup, m.start(), m.end()
        kind = next(k for k in ("line", "open", "quote", "slash", "brace", "here", "hash", "block", "over", "percent", "end", "s1", "s2", "s3", "s4") if k in m.re.groupindex and m[k] is not None)
        if heredocs and (stop := text.find("\n", pos, at)) >= 0:
            pos = bodies(stop + 1)
            continue
        if kind in ("line", "hash", "block"):
            if kind == "line" and family == "php" and (over := text.find("?>", at, to)) >= 0:
                to = over
            comments.append((at, to))
            blank(at, to)
        elif kind == "open":
            depth, to = 1, at + 2
            while depth:
                edge = _COMMENT_EDGE.search(text, to)
                if not edge:
                    to = size
                    break
                depth += 1 if edge[0] == "/*" and family in _NESTED else -1 if edge[0] == "*/" else 0
                to = edge.end()
            comments.append((at, to))
            blank(at, to)
        elif kind == "quote":
            modes.append([m["quote"], 0])
            blank(at, to)
            to = inside(m["quote"], to)
        elif kind == "brace":
            if modes:
                _, _, _, opening, closing = _INSIDE[family, modes[-1][0]]
                if m[0] == opening:
                    modes[-1][1] += 1
                elif m[0] == closing:
                    modes[-1][1] -= 1
                    if modes[-1][1] == 0:
                        blank(at, to)
                        to = inside(modes[-1][0], to)
        elif kind == "slash":
            if _is_regex(text, at, family) and (r := _REGEX.match(text, at)):
                to = r.end()
                blank(at, to)
        elif kind == "here":
            blank(at, to)
            if family == "php":
                over = re.compile(rf"^[ \t]*{m['tag']}\b", re.M).search(text, to)
                blank(to, over.end() if over else size)
                to = over.end() if over else size
            else:
                heredocs.append(m["tag"])
        elif kind == "percent":
            before = text[at - 1 : at]
            if before.isalnum() or before in (")", "]") or (text[at + 1] in "(</|! " and before not in ("", " ", "(", ",", "=", "\n")):
                to = at + 1
            else:
                opening = m["p"]
                closing, depth = _CLOSING.get(opening, opening), 1
                while to < size and depth:
                    c = text[to]
                    depth += -1 if c == closing else 1 if c == opening else 0
                    to += 2 if c == "\\" else 1
                blank(at, to)
        elif kind == "end":
            more = re.compile(r"<\?(?:php|=)?").search(text, to)
            to = more.end() if more else size
            blank(at, to)
        else:
            blank(at + (family == "python"), size if kind == "over" else to)  # there a quote is left, as a string is a statement
            to = size if kind == "over" else to
        pos = max(to, at + 1)
    if heredocs and (stop := text.find("\n", pos)) >= 0:
        bodies(stop + 1)
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            out += [text[at:a] if a > at else "", _BLANK.sub(" ", text[max(a, at) : b])]
            at = b
    code = "".join(out) + text[at:]
    noted = set(comments)
    return Lexed(_first_branches(code, _PREPROCESSED[family]) if family in _PREPROCESSED and "#" in code else code, comments, [x for x in sorted(spans) if x not in noted])


def _first_branches(code: str, words: frozenset | None) -> str:
    """The text without directives, and without the branches after the first of each condition (the second, where the first is never taken)."""
    out, at, skipped = [], 0, []  # for each open condition: whether its present branch is left out, and whether one was taken
    hidden = False
    for m in _DIRECTIVE.finditer(code):
        if words is not None and m[1] not in words:
            continue
        out += [_BLANK.sub(" ", code[at : m.start()]) if hidden else code[at : m.start()], _BLANK.sub(" ", m[0])]
        at = m.end()
        if m[1] in ("if", "ifdef", "ifndef"):
            never = m[1] == "if" and m[2].strip() in ("0", "false")
            skipped.append([never, not never])
        elif m[1] in ("else", "elif") and skipped:
            skipped[-1] = [skipped[-1][1], True]
        elif m[1] == "endif" and skipped:
            skipped.pop()
        hidden = any(s for s, _ in skipped)
    rest = code[at:]
    return "".join(out) + (_BLANK.sub(" ", rest) if hidden else rest)


class Lines:
    """Lines of a text, from 1, by offset."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)

    def start(self, line: int) -> int:
        return self.starts[line - 1]
