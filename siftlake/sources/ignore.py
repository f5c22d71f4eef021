"""Ignore rules: which paths of a tree are left out. The last matching rule decides."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# Directories that are never indexed.
DEFAULT_DIRS = [
    ".git/", ".hg/", ".svn/", "__pycache__/", "node_modules/", ".venv/", "venv/", ".tox/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/",
    ".cache/", ".siftlake/", ".next/", "dist/", "build/", ".eggs/",
]
FILES = (".gitignore", ".siftignore")


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file, for paths relative to ``base``."""

    base: str
    pattern: str
    regex: re.Pattern
    negated: bool
    dirs_only: bool

    @property
    def names_suffix(self) -> bool:
        """Whether a negation names files by suffix and so lets them pass the suffix filter."""
        last = self.pattern.rstrip("/").rsplit("/", 1)[-1]
        return self.negated and bool(re.search(r".\.[^.]+$", last))


@lru_cache(maxsize=10_000)
def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parse(lines: list[str], base: str = "") -> list[Rule]:
    """Rules of an ignore file; comments, blank lines and lines that say nothing are left out."""
    rules = []
    for line in lines:
        text = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
        if not text or text.startswith("#"):
            continue
        negated = text.startswith("!")
        text = text[1:] if negated else text
        dirs_only = text.endswith("/")
        body = text.rstrip("/")
        if not body:
            continue
        anchored = "/" in body
        body = body.lstrip("/")
        regex = re.compile(("" if anchored else "(?:.*/)?") + _glob(body) + "(?:/.*)?", re.S)
        rules.append(Rule(base.strip("/"), text, regex, negated, dirs_only))
    return rules


def is_ignored(path: str, is_dir: bool, rules: list[Rule]) -> tuple[bool, bool]:
    """(ignored, passes the suffix filter) of a path relative to the root."""
    ignored = passes = False
    for rule in rules:
        if rule.base and not path.startswith(rule.base + "/"):
            continue
        relative = path[len(rule.base) + 1 :] if rule.base else path
        if rule.dirs_only and not is_dir:
            # A file can only lie below a directory that the rule names.
            hit = any(rule.regex.fullmatch(relative[: m.start()]) for m in re.finditer("/", relative))
        else:
            hit = rule.regex.fullmatch(relative) is not None
        if hit:
            ignored, passes = not rule.negated, rule.names_suffix
    return ignored, passes
