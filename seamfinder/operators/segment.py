"""Declarations of a source text as a forest: by braces, by indentation, or by end keywords.

Strings and comments are blanked first (lexer). In a language with braces, what
stands between the last boundary and a brace is the head of what the braces hold;
the language's rules say which heads are declarations, and of what kind. So a
brace may be on a line of its own, and what is enclosed by what comes from the
stack of open braces. Blocks are in the order of their starts, each with its
place in its parent, so a block's descendants follow it; comments belong to what
follows them there, or else to what they are in.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from ..sources.corpus import LANGUAGES
from .lexer import Lexed, Lines, lex


class Block(NamedTuple):
    """Lines from 1. first: where the comments and attributes above begin; parent: place in the list, or -1."""

    start: int
    end: int
    kind: str
    name: str
    parent: int
    is_test: bool
    first: int


_NOT_NAMES = "if|for|while|switch|return|else|do|catch|match|new|throw|sizeof|try|using|lock|foreach|elseif|when|guard|where|defer|unless|until|loop|in|await|yield|case|typeof"
_CALL = rf"(?!(?:{_NOT_NAMES})\b)"
_MODIFIERS = r"(?:@\w+(?:\([^)]*\))?\s*|\[[^\]]*\]\s*|(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|readonly|synchronized|native|default|unsafe|extern|open|fileprivate|mutating|required|convenience|lazy|weak|indirect|strictfp|transient|volatile|new)\b\s*)*"
_JS = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"

#: For each family: (pattern of a head, kind, where it holds: anywhere, in a type, out of types, flat (out of functions), free (out of both)). Kinds are fixed values, the names that grammars give.
_RULES: dict[str, list[tuple[str, str, str]]] = {
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s*)?)*fn\s+(\w+)", "function_item", ""),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(\w+)", "struct_item", ""),
        (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum_item", ""),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", "trait_item", ""),
        (r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", "mod_item", ""),
        (r"(?:unsafe\s+)?impl\b.*\bfor\s+&?(?:\w+::)*(\w+)", "impl_item", ""),
        (r"(?:unsafe\s+)?impl\b\s*(?:<.*?>\s*)?(?:\w+::)*(\w+)", "impl_item", ""),
        (r"macro_rules!\s*(\w+)", "macro_definition", ""),
        (r"(?:\w+::)*(\w+)!$", "token_tree", ""),
    ],
    "js": [
        (_JS + r"function\s*\*?\s*(\w+)?\s*[(<]", "function_declaration", ""),
        (_JS + r"class\b(?:\s+(?!extends\b|implements\b)(\w+))?", "class_declaration", ""),
        (r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+(\w+)", "interface_declaration", ""),
        (r"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(\w+)", "enum_declaration", ""),
        (r"(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([\w.]+)", "namespace_declaration", ""),
        (r"(?:export\s+)?declare\s+(?:module|(global))\s*$", "declare_statement", ""),
        (r"(?:export\s+)?type\s+(\w+)[^=]*=", "type_alias_declaration", ""),
        (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\b[^=]*=\s*(?:async\s+)?function\b", "function_expression", ""),
        (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\b[^=]*=\s*(?:async\s*)?.*=>\s*$", "arrow_function", ""),
        (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\b[^=]*=\s*$", "object", ""),
        (r"export()$", "export_statement", ""),
        (r"export\s+(default)$", "object", ""),
        (r"(?:[\w$]+\.)+(\w+)\s*=\s*(?:async\s+)?function\b", "function_expression", ""),
        (r"(?:[\w$]+\.)+(\w+)\s*=\s*(?:async\s*)?.*=>\s*$", "arrow_function", ""),
        (r"(\w+)\s*:\s*(?:async\s+)?function\b", "function_expression", "in"),
        (r"(\w+)\s*:\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]*)?=>\s*$", "arrow_function", "in"),
        (r"(?:(?:static|public|private|protected|readonly|override)\s+)*#?(\w+)\s*(?::[^=]*)?=\s*(?:async\s*)?.*=>\s*$", "arrow_function", "in"),
        (r"(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+|readonly\s+|override\s+|\*\s*)*" + _CALL + r"#?(\w+)\s*(?:<[^>]*>)?\s*\(.*\)\s*(?::[^{]*)?$", "method_definition", "in"),
    ],
    "java": [
        (_MODIFIERS + r"(?:class|record)\s+(\w+)", "class_declaration", ""),
        (_MODIFIERS + r"@?interface\s+(\w+)", "interface_declaration", ""),
        (_MODIFIERS + r"enum\s+(\w+)", "enum_declaration", ""),
        (r"static()$", "static_initializer", "in"),
        (_MODIFIERS + _CALL + r"(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w.,\s]+)?$", "constructor_declaration", "in"),
        (_MODIFIERS + _CALL + r"(?:<[^>]*>\s*)?[\w.<>\[\],? ]+\s+(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w.,\s]+)?$", "method_declaration", "in"),
    ],
    "csharp": [
        (_MODIFIERS + r"(?:class|record)\s+(\w+)", "class_declaration", ""),
        (_MODIFIERS + r"struct\s+(\w+)", "struct_declaration", ""),
        (_MODIFIERS + r"interface\s+(\w+)", "interface_declaration", ""),
        (_MODIFIERS + r"enum\s+(\w+)", "enum_declaration", ""),
        (r"namespace\s+([\w.]+)", "namespace_declaration", ""),
        (_MODIFIERS + r"event\s+[\w.<>\[\],? ]+\s+(\w+)$", "event_declaration", "in"),
        (_MODIFIERS + _CALL + r"(\w+)\s*\([^;]*\)\s*(?::\s*(?:base|this)\s*\(.*\))?$", "constructor_declaration", "in"),
        (_MODIFIERS + _CALL + r"[\w.<>\[\],? ]+\s+(\w+)\s*(?:<[^>]*>)?\s*\([^;]*\)\s*(?:where\b.*)?$", "method_declaration", "in"),
        (_MODIFIERS + _CALL + r"[\w.<>\[\],? ]+\s+(\w+)$", "property_declaration", "in"),
    ],
    "c": [
        (r"(?:typedef\s+)?(?:template\s*<.*?>\s*)?(?:struct|union)\b\s*(\w+)?\s*(?:final\s*)?(?::[^:=][^=]*)?$", "struct_specifier", ""),
        (r"(?:typedef\s+)?enum\s+(?:class\s+|struct\s+)?(\w+)", "enum_specifier", ""),
        (r"(?:template\s*<.*?>\s*)?class\s+(\w+)", "class_specifier", ""),
        (r"(?:inline\s+)?namespace\s+([\w:]+)", "namespace_definition", ""),
        (r"(?:template\s*<.*?>\s*)?" + _CALL + r"(?:[\w:<>,*&~\[\]]+\s*[*&\s]\s*)*" + _CALL + r"((?:\w+::)*~?\w+|operator\s*\S+)\s*\([^;]*\)\s*(?:const|noexcept|override|final|\s)*(?:->\s*[\w:<>*& ]+)?(?::\s*[^:].*)?$", "function_definition", ""),
    ],
    "go": [
        (r"func\s*\([^)]*\)\s*(\w+)", "method_declaration", ""),
        (r"func\s+(\w+)", "function_declaration", ""),
        (r"type\s+(\w+)\b.*\b(?:struct|interface)$", "type_declaration", ""),
    ],
    "php": [
        (_MODIFIERS + r"class\s+(\w+)", "class_declaration", ""),
        (r"interface\s+(\w+)", "interface_declaration", ""),
        (r"trait\s+(\w+)", "trait_declaration", ""),
        (_MODIFIERS + r"function\s+&?\s*(\w+)", "method_declaration", "in"),
        (r"function\s+&?\s*(\w+)", "function_definition", "out"),
    ],
    "swift": [
        (_MODIFIERS + r"(?:class\s+|static\s+)?func\s+(\w+)", "function_declaration", ""),
        (_MODIFIERS + r"(?:class|actor)\s+(\w+)", "class_declaration", ""),
        (_MODIFIERS + r"struct\s+(\w+)", "struct_declaration", ""),
        (_MODIFIERS + r"enum\s+(\w+)", "enum_declaration", ""),
        (_MODIFIERS + r"protocol\s+(\w+)", "protocol_declaration", ""),
        (_MODIFIERS + r"extension\s+([\w.]+)", "extension_declaration", ""),
        (_MODIFIERS + r"(init)\b", "function_declaration", "in"),
        (_MODIFIERS + r"var\s+(\w+)", "variable_declaration", ""),
    ],
}
#: Declarations that end with a semicolon, or with their line.
_FIELD = r"(?:<[^>]*>\s*)?[\w.<>\[\],? ]*[\w>\]?]\s+"
_SHORT: dict[str, list[tuple[str, str, str]]] = {
    "rust": [_RULES["rust"][1]],
    "js": [
        (r"(?:export\s+)?declare\s+(?:(?:const|let|var|function|class|type)\s+)?(\w+)", "declare_statement", ""),
        (r"(?:export\s+)?type\s+(\w+)[^=]*=", "type_alias_declaration", ""),
        (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\w+)\s*(?::[^=]*)?=>", "arrow_function", ""),
        (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]*)?=\s*\[", "array", ""),
        (r"export\s+(?:(?:default|const|let|var)\s+(\w+)|(?=\*))", "export_statement", ""),
    ],
    "csharp": [
        (_MODIFIERS + r"delegate\s+.*?(\w+)\s*\(", "delegate_declaration", ""),
        (_MODIFIERS + r"event\s+[\w.<>\[\],? ]+\s+(\w+)$", "event_declaration", "in"),
        (_MODIFIERS + _CALL + _FIELD + r"(\w+)\s*(?:<[^>]*>)?\s*\([^;]*\)\s*(?:where\b.*)?(?:=>.*)?$", "method_declaration", "in"),
        (_MODIFIERS + _CALL + _FIELD + r"(\w+)\s*=>", "property_declaration", "in"),
    ],
    "java": [
        (_MODIFIERS + _CALL + r"(?:<[^>]*>\s*)?[\w.<>\[\],? ]+\s+(\w+)\s*\([^;=]*\)\s*(?:throws\s+[\w.,\s]+)?$", "method_declaration", "in"),
        (_MODIFIERS + _CALL + _FIELD + r"(\w+)\s*(?:\[\s*\])*\s*(?:=.*)?$", "field_declaration", "in"),
    ],
    "c": [(r"(?!(?:typedef|using|return|goto|delete|friend|public|private|protected|else|case|template|extern\s*$)\b)" + _CALL + r"(?:[\w:<>,*&~\[\]]+\s*[*&\s]\s*)+(\w+)\s*(?:\[[^\]]*\]\s*)*(?:=.*|\([^;]*\)\s*(?:const|noexcept|override|=\s*\w+|\s)*)?$", "declaration", "free")],
    "go": [(r"type\s+(\w+)\b", "type_declaration", "")],
    "swift": [(_MODIFIERS + r"typealias\s+(\w+)", "typealias_declaration", "flat"), (_MODIFIERS + r"let\s+(\w+)", "constant_declaration", "flat"), (_MODIFIERS + r"var\s+(\w+)", "variable_declaration", "flat"), (_MODIFIERS + r"func\s+(\w+)", "function_declaration", "in")],
}
#: What a line begins with that may be a whole declaration, in languages where a newline ends a statement.
_LINE_BEGINS = {
    "js": re.compile(r"\s*(?:export|declare|const|let|var|type)\b"),
    "go": re.compile(r"\s*type\b"),
    "swift": re.compile(r"\s*(?:@\w+\s+)*(?:(?:public|private|internal|fileprivate|open|static|final|lazy|weak|override|mutating|class)\s+)*(?:typealias|let|var|func)\b"),
}
_GOES_ON = re.compile(r"(?:[=,(\[{+\-*/&|?:.<]|=>|\b(?:extends|in|of|as))$")
_GOES_ON_NEXT = re.compile(r"\s*(?:[.?:,=)\]+*/&|{]|-[^-]|(?:extends|implements|where|throws)\b)")
_LABELS = re.compile(r"(?:<\?php\b|(?:public|private|protected|signals)\s*(?:\w+\s*)?:(?!:)|package\s+\w+(?=\n))\s*")
_LEAD = {"rust": re.compile(r"(?:#!?\[[^\]]*\]\s*)*"), "php": re.compile(r"(?:<\?php\s*)?(?:#\[[^\]]*\]\s*)*"), "js": re.compile(r"(?:@\w+(?:\([^)]*\))?\s*)*")}
_COMPILED = {k: [(re.compile(p, re.S), kind, where) for p, kind, where in v] for k, v in _RULES.items()}
_COMPILED_SHORT = {k: [(re.compile(p, re.S), kind, where) for p, kind, where in v] for k, v in _SHORT.items()}
_FAMILY = {"rust": "rust", "javascript": "js", "typescript": "js", "java": "java", "csharp": "csharp", "c": "c", "cpp": "c", "go": "go", "php": "php", "swift": "swift", "python": "python", "ruby": "ruby"}
_TYPES = re.compile(r"class|struct|enum|interface|trait|impl|protocol|extension|record|object")
_CALLABLE = re.compile(r"function|method|constructor|initializer|^class$|^module$")
#: Braces without a name of their own whose content is like a type's: the body of an anonymous class or of an enum's constant, an object.
_TYPE_LIKE = {"java": re.compile(r"new\s+[\w.<>, ]+\([^{}]*\)$|(?:^|,)\s*\w+\s*(?:\([^{}]*\))?$", re.S), "csharp": None, "js": re.compile(r"(?:[=(,:\[?]|=>\s*\(|\breturn|\bdefault)$")}
_ABOVE = re.compile(r"^\s*(?://|/\*|\*|#|--|@\w|\[\w)")
_DIRECTIVE = re.compile(r"^\s*#\s*(?:include|define|if|ifdef|ifndef|endif|else|elif|pragma|undef|error|line|region|endregion)\b")
# What makes a declaration a test, by language: the kinds and their names, what stands above or at the beginning, calls that hold tests.
_TEST_NAMES = {
    "go": [("function_declaration", r"^Test")], "python": [("function_definition", r"^test_")], "ruby": [("method", r"^test_")], "php": [("method_declaration", r"^test")], "swift": [("function_declaration", r"^test")],
    "c": [("function_definition", r"test|Test")], "rust": [("function_item", r"^test_"), ("mod_item", r"^tests?$")], "js": [("function_declaration", r"test|Test"), ("method_definition", r"test|Test"), ("arrow_function", r"test|Test")],
    "csharp": [("method_declaration", r"^Test"), ("class_declaration", r"Tests?$")],
}
_TEST_MARKS = {
    "rust": [("", r"#\[(?:\w+::)*test\b|#\[cfg\(test\)\]")], "java": [("method_declaration", r"@Test")], "php": [("method_declaration", r"@test\b")],
    "csharp": [("method_declaration", r"\[(?:Test|Fact|Theory)"), ("class_declaration", r"\[(?:TestClass|TestFixture)")], "swift": [("function_declaration", r"@Test"), ("class_declaration", r"\bXCTestCase\b")],
}
_TEST_CALLS = {"js": re.compile(r"(?:^|[^\w.])(?:describe|it|test|expect)(?:\.\w+)*\s*\("), "ruby": re.compile(r"^\s*(?:RSpec\.)?(?:describe|it|context|specify)\b")}


def language_of(ext: str | None) -> str | None:
    return next((name for name, exts in LANGUAGES.items() if (ext or "").lower() in exts), None)


def _rule(head: str, family: str, rules: dict, inside: str | None, flat: bool):
    """(how much of the head is attributes, kind, name) by the first rule that fits. inside: the kind that braces around it have; flat: no function is around it."""
    lead = _LEAD[family].match(head).end() if family in _LEAD else 0
    typed = bool(inside and _TYPES.search(inside))
    for pattern, kind, where in rules.get(family, ()):
        if where == "in" and not typed or where == "out" and typed or where in ("flat", "free") and not flat or where == "free" and typed:
            continue
        if m := pattern.match(head, lead):
            return lead, kind, m[1] or ("default" if re.search(r"\bdefault\b", head) else "")
    return None


class _Brace(NamedTuple):
    """An open brace: the block it opens, if it does; open brackets around it; the kind that its content sees; whether it is in a function, whether in a test."""

    block: int | None
    depth: int
    kind: str | None
    function: bool
    test: bool


def _braces(text: str, family: str) -> list[list]:
    """[start offset, end offset, kind, name, parent, is in a call that holds tests]; in order of their starts."""
    found: list[list] = []
    stack: list[_Brace] = []
    boundary, depth = 0, 0
    begins, calls, type_like = _LINE_BEGINS.get(family), _TEST_CALLS.get(family), _TYPE_LIKE.get(family)
    none = _Brace(None, 0, None, False, False)

    def head(to: int) -> tuple[int, str]:
        raw = text[boundary:to]
        if family == "js":  # in an object, what is before ends with a comma
            raw = re.sub(r"^[\s,]+", "", raw)
        start = to - len(raw.lstrip())
        if m := _LABELS.match(text, start, to):
            raw, start = text[m.end() : to], m.end()
        if family in ("go", "swift", "js"):  # a newline may end a statement: the head begins on the last line that begins one
            lines = raw.strip().split("\n")
            for i in range(len(lines) - 1, -1, -1):
                cut = "\n".join(lines[i:]).strip()
                if cut and cut.count("(") == cut.count(")") and cut.count("[") == cut.count("]") and (i == 0 or not _GOES_ON_NEXT.match(cut) and not _GOES_ON.search(lines[i - 1].rstrip())):
                    return to - len(raw) + raw.rstrip().rfind(cut), cut
        return start, raw.strip()

    def add(start: int, end: int | None, hit) -> None:
        parent = next((b.block for b in reversed(stack) if b.block is not None), -1)
        found.append([start + hit[0], end, *hit[1:], parent, bool(stack) and stack[-1].test])

    def short(at: int, to: int) -> bool:
        start, own = head(at)
        top = stack[-1] if stack else none
        if own and (hit := _rule(own, family, _COMPILED_SHORT, top.kind, not top.function)):
            add(start, to, hit)
            return True
        return False

    for m in re.finditer(r"[{}()\[\];\n]" if begins else r"[{}()\[\];]", text):
        c, at = m[0], m.start()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == "\n":
            if depth == 0 and not _GOES_ON_NEXT.match(text, at) and not _GOES_ON.search(text[boundary:at].rstrip()):
                if begins.search(text, boundary, at):
                    short(at, at)
                boundary = at + 1
        elif c == "{":
            start, own = head(at)
            top = stack[-1] if stack else none
            hit = _rule(own, family, _COMPILED, top.kind, not top.function) if own else None
            test = top.test or bool(calls and calls.search(text[boundary:at]))
            if hit:
                stack.append(_Brace(len(found), depth, hit[1], top.function and not _TYPES.search(hit[1]) or bool(_CALLABLE.search(hit[1])), test))
                block = stack.pop()
                add(start, None, hit)
                stack.append(block)
            else:
                like = type_like and type_like.search(own) and (family != "java" or own.startswith("new") or " new " in f" {own}" or top.kind == "enum_declaration")
                stack.append(_Brace(None, depth, "object" if like else None, top.function or bool(own and own[-1] == ")" and not like), test))
            boundary, depth = at + 1, 0
        elif c == "}":
            if stack:
                block, depth, *_ = stack.pop()
                if block is not None:
                    found[block][1] = at + 1
            boundary = at + 1
        elif depth == 0:
            short(at, at + 1)
            boundary = at + 1
    for block in found:
        block[1] = len(text.rstrip()) if block[1] is None else block[1]
    return found


_DEFINITION = re.compile(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)")


def _indented(text: str, strings: list[tuple[int, int]]) -> list[list]:
    """By indentation; lines inside of brackets or strings, or after a backslash, go on with the line before. A decorated definition is one around it, without a name."""
    found, stack, at, last, depth, more, decorated, k = [], [], 0, 0, 0, False, None, 0
    for line in text.split("\n"):
        own = line.strip()
        while k < len(strings) and strings[k][1] < at:
            k += 1
        if k < len(strings) and strings[k][0] < at:
            more, last = True, min(strings[k][1], at + len(line))
        if own and not depth and not more:
            indent = len(line.expandtabs()) - len(line.expandtabs().lstrip())
            while stack and indent <= stack[-1][0]:
                found[stack.pop()[1]][1] = last
            m = _DEFINITION.match(line)
            parent = stack[-1][1] if stack else -1
            if own.startswith("@") and decorated is None:
                decorated = at + len(line) - len(line.lstrip())
            elif m:
                if decorated is not None:
                    found.append([decorated, None, "decorated_definition", "", parent, False])
                    stack.append((indent, len(found) - 1))
                found.append([at + len(m[1]), None, "class_definition" if m[2] == "class" else "function_definition", m[3], parent, False])
                stack.append((indent, len(found) - 1))
            if not own.startswith("@"):
                decorated = None
        if own:
            depth = max(0, depth + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
            last = at + len(line.rstrip())
        more = line.endswith("\\")
        at += len(line) + 1
    for _, i in stack:
        found[i][1] = last
    return found


_RUBY = re.compile(r"^[ \t]*(?:(?:private|public|protected|private_class_method|memoize)\s+)?(?P<open>(?P<k>def|class|module)\s+(?P<self>self\.)?(?P<n>[\w?!=:]+|<<\s*self)|(?:if|unless|while|until|case|for|begin)\b)|(?:=|<<|\breturn)[ \t]*(?P<value>(?:if|unless|case|begin|while)\b)|(?P<do>\bdo\b(?:[ \t]*\|[^|\n]*\|)?[ \t]*$)|(?:^|;)[ \t]*(?P<end>end)\b", re.M)


def _ended(text: str) -> list[list]:
    found: list[list] = []
    stack: list[tuple[int | None, bool]] = []  # the block that a keyword opens, if it does; whether it is in a test
    for m in _RUBY.finditer(text):
        line_at = text.rfind("\n", 0, m.end()) + 1 if m["do"] else m.start()
        over = text.find("\n", m.end())
        line = text[line_at : over if over >= 0 else len(text)]
        test = bool(stack) and stack[-1][1]
        if m["end"]:
            block = stack.pop()[0] if stack else None
            if block is not None:
                found[block][1] = m.end()
        elif m["open"] and m["k"] and not (m["n"] or "").startswith("<<"):
            parent = next((b for b, _ in reversed(stack) if b is not None), -1)
            kind = {"class": "class", "module": "module"}.get(m["k"], "singleton_method" if m["self"] else "method")
            start = m.start("open")
            one = m["k"] == "def" and re.search(r"\)\s*=\s|\bdef\s+\w+[?!]?\s*=\s", line)
            found.append([start, m.start() + len(line.rstrip()) if one else None, kind, m["n"], parent, test])
            if not one:
                stack.append((len(found) - 1, test))
        elif m["do"] or not re.search(r"[^;\s]\s+end\b", line):  # else it ends on its line
            if m["do"] and re.match(r"[ \t]*(?:while|until|for)\b", line):
                continue  # its ``do`` belongs to the keyword
            stack.append((None, test or bool(m["do"] and _TEST_CALLS["ruby"].search(line))))
    for block in found:
        block[1] = len(text.rstrip()) if block[1] is None else block[1]
    return found


def declared(lexed: Lexed, family: str) -> list[list]:
    """[start offset, end offset, kind, name, parent, is in a call that holds tests] of a text's declarations, in order of their starts."""
    if family == "python":
        return _indented(lexed.code, lexed.strings)
    return _ended(lexed.code) if family == "ruby" else _braces(lexed.code, family)


class Comment(NamedTuple):
    """Lines that are a comment and nothing else, and the block they belong to: its place in the list, or -1."""

    start: int
    end: int
    block: int


def forest(content: str, ext: str) -> tuple[list[Block], list[Comment]]:
    """The declarations of a text in order of their starts, and its comments; texts of unknown languages have none."""
    language = language_of(ext)
    if language is None or not content:
        return [], []
    family = _FAMILY[language]
    lexed = lex(content, family)
    code, comments, found, at = lexed.code, lexed.comments, declared(lexed, family), Lines(content)
    found = [x for x in found if x[2] != "token_tree" or at.of(x[1] - 1) - at.of(x[0]) > 5]  # only large ones count; they hold no others
    lines = content.split("\n")
    out: list[Block] = []
    for s, e, kind, name, parent, in_test in found:
        if family == "java" and kind == "constructor_declaration" and (parent < 0 or found[parent][3] != name):
            kind = "method_declaration"
        start, end = at.of(s), at.of(max(s, e - 1))
        first = start
        while first > 1 and _ABOVE.match(lines[first - 2]) and not _DIRECTIVE.match(lines[first - 2]):
            first -= 1
        named = any(kind == k and re.search(p, name) for k, p in _TEST_NAMES.get(family, ()))
        marks = [p for k, p in _TEST_MARKS.get(family, ()) if k in ("", kind)]
        text = "\n".join(lines[first - 1 : start]) + content[s : s + 300].split("{")[0] if marks else ""
        test = named or in_test or any(re.search(p, text) for p in marks)
        out.append(Block(start, end, kind, name, parent, test or parent >= 0 and out[parent].is_test, first))
    for i, b in enumerate(out[:-1]):
        if b.kind == "decorated_definition" and out[i + 1].is_test:
            out[i] = b._replace(is_test=True)
    return out, _owned(code, comments, found, lines, at)


def _owned(code: str, comments: list[tuple[int, int]], found: list[list], lines: list[str], at: Lines) -> list[Comment]:
    """Comments with their blocks: the next one in what they are in, however far; at a file's end the one before; else what they are in."""
    alone = [(a, b) for a, b in comments if not code[at.start(at.of(a)) : a].strip()]
    out, open_, k = [], [], 0
    children: dict[int, list[int]] = {}
    for i, x in enumerate(found):
        children.setdefault(x[4], []).append(i)
    place: dict[int, int] = {}
    for a, b in alone:
        while k < len(found) and found[k][0] <= a:
            open_.append(k)
            k += 1
        open_ = [i for i in open_ if found[i][1] > a]
        inner = open_[-1] if open_ else -1
        if inner >= 0 and found[inner][2] == "decorated_definition":
            inner = found[inner][4]
        own = children.get(inner, [])
        i = place.get(inner, 0)
        while i < len(own) and found[own[i]][0] < b:
            i += 1
        place[inner] = i
        if i < len(own):
            block = own[i]
        elif inner < 0 and own and not code[b:].strip() and not code[found[own[-1]][1] : a].strip():
            block = own[-1]
        else:
            block = inner
        out.append(Comment(at.of(a), at.of(max(a, b - 1)), block))
    return out


def segment(content: str, ext: str) -> list[Block]:
    """The declarations of a text in order of their starts; texts of unknown languages have none."""
    return forest(content, ext)[0]


# Kinds that stay beside what is around them, and kinds in order of priority, lowest first.
_IMPORTANT = frozenset("function_declaration method_declaration function_item impl_item type_declaration struct_item block_comment compilation_unit global_attribute".split())
_PRIORITY = {k: i for i, k in enumerate("compilation_unit function_declaration method_declaration function_item impl_item type_declaration struct_item class class_declaration global_attribute".split())}


def settled(chosen: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What stays of ranges (start, end, kind) that were chosen in one text, in order of their starts.

    Of two of which one lies in the other, an important kind stays beside one
    that isn't, if it comes later; what isn't important goes beside one that is.
    Else priority decides, and without one the inner stays. What overlaps an
    earlier one partly goes.
    """
    kept: list[tuple[int, int, str]] = []
    for x in sorted(set(chosen), key=lambda x: (x[0], -x[1], x[2])):
        gone, add = [], True
        for y in kept:
            if x[0] > y[1] or y[0] > x[1]:
                continue
            inside, around = y[0] <= x[0] and x[1] <= y[1], x[0] <= y[0] and y[1] <= x[1]
            mine, theirs = x[2] in _IMPORTANT, y[2] in _IMPORTANT
            if not inside and not around or theirs and not mine:
                add = False
            elif mine and not theirs:
                continue
            elif x[2] in _PRIORITY and y[2] in _PRIORITY:
                add = _PRIORITY[x[2]] > _PRIORITY[y[2]]
                gone += [y] if add else []
            else:
                add = inside
                gone += [y] if inside else []
            if not add:
                break
        if add:
            kept = [y for y in kept if y not in gone] + [x]
    return sorted(kept)
