"""Names of dependencies to folders: ``go:``, ``js:`` and ``rust:`` names, and the same as ``/dep/go/...``.

How a name divides into a module and what lies below it is settled here. Where a
module is, a resolver says, a function from a module's name to a folder; those
that ask the language's own tools run on the driver.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Callable

LANGUAGES = ("go", "js", "rust")
# Hosts whose modules have three parts.
HOSTS = ("github.com", "gitlab.com", "bitbucket.org")


class ResolveError(ValueError):
    pass


def divided(language: str, name: str) -> tuple[str, str | None]:
    """(module, what lies below it or None)."""
    if not name:
        raise ResolveError(f"an empty {language} path")
    if language == "rust":
        return name, None
    if ".." in name:
        raise ResolveError(f"'..' in a {language} path")
    parts = name.rstrip("/").split("/")
    if language == "js":
        n = 2 if parts[0].startswith("@") else 1
        if len(parts) < n or not all(parts[:n]) or parts[0] == "@":
            raise ResolveError(f"not a package: {name}")
    elif len(parts) >= 3 and (parts[0] in HOSTS or parts[:2] == ["golang.org", "x"]):
        n = 3
    else:  # a package of the standard library, and perhaps a file in it
        n = len(parts) - 1 if len(parts) > 1 and "." in parts[-1] else len(parts)
    return "/".join(parts[:n]), "/".join(parts[n:]) or None


def _asked(*command: str) -> str:
    try:
        return subprocess.run(command, capture_output=True, text=True, check=True, timeout=60).stdout.strip()
    except (OSError, subprocess.SubprocessError) as e:
        raise ResolveError(f"{command[0]} gives no answer: {e}") from e


def _go(module: str) -> str:
    return _asked("go", "list", "-f", "{{.Dir}}", module)


def _js(module: str) -> str:
    for root in ("node_modules", _asked("npm", "root", "-g")):
        if os.path.isdir(os.path.join(root, module)):
            return os.path.join(root, module)
    raise ResolveError(f"not installed: {module}")


def _rust(module: str) -> str:
    if os.path.exists(module):
        return module if os.path.isdir(module) else os.path.dirname(module)
    for package in json.loads(_asked("cargo", "metadata", "--format-version", "1"))["packages"]:
        if package["name"] == module:
            return os.path.dirname(package["manifest_path"])
    raise ResolveError(f"not a dependency: {module}")


RESOLVERS: dict[str, Callable[[str], str]] = {"go": _go, "js": _js, "rust": _rust}


def resolve(path: str, resolvers: dict[str, Callable[[str], str]] = RESOLVERS) -> str:
    """A path as it is, unless it names a dependency; drive letters name none."""
    if re.match(r"[A-Za-z]:[\\/]", path):
        return path
    if m := re.fullmatch(r"/dep/([^/]*)(?:/(.*))?", path, re.S):
        language, name = m[1], m[2] or ""
        if language not in LANGUAGES:
            raise ResolveError(f"unknown language: {language}")
    elif m := re.fullmatch(f"({'|'.join(LANGUAGES)}):(.*)", path, re.S):
        language, name = m[1], m[2]
    else:
        return path
    module, below = divided(language, name)
    folder = resolvers[language](module)
    return os.path.join(folder, below.lstrip("/")) if below else folder
