"""Rules of .gitignore files."""

from __future__ import annotations

import re


class GitIgnore:
    """The rules of .gitignore files, as they hold below the folders that have them; the last rule that matches decides."""

    def __init__(self):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def read(self, folder: str, text: str) -> None:
        for raw in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", raw)
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            fixed = "/" in line
            self.rules.append((folder, re.compile(("" if fixed else "(?:.*/)?") + self.pattern(line.lstrip("/"))), keep, only_dirs))

    @staticmethod
    def pattern(glob: str) -> str:
        out = ""
        for m in re.finditer(r"\*\*/|/\*\*$|\*|\?|\[[^\]]+\]|\\?.", glob):
            t = m[0]
            out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(t) or ("[" + t[1:-1].replace("!", "^", 1) + "]" if t[0] == "[" and len(t) > 2 else re.escape(t.removeprefix("\\") or "\\"))
        return out

    def __call__(self, path: str, is_dir: bool) -> bool:
        for folder, pattern, keep, only_dirs in reversed(self.rules):
            own = path[len(folder) :].lstrip("/") if path.startswith(folder) else None
            if own and (is_dir or not only_dirs) and pattern.fullmatch(own):
                return not keep
        return False
