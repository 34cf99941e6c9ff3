"""Ignore rules of source trees, as version control reads them."""

from __future__ import annotations

import re
from typing import NamedTuple

from lodestar.functions.regex import glob_to_regex

# Directories (and one file) that are never entered.
ALWAYS_SKIP = frozenset(".git .hg .svn .jj .DS_Store node_modules __pycache__ .venv .build DerivedData .gradle .mypy_cache .pytest_cache .ruff_cache .tox .next .turbo .parcel-cache".split())


class Rule(NamedTuple):
    pattern: re.Pattern
    keep: bool
    only_dirs: bool


def parse_rules(text: str) -> list[Rule]:
    """The rules of an ignore file, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line[1:] if line.startswith(("\\!", "\\#")) else line
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        if line:
            # a slash before the end anchors the rule to its file's directory
            anchored = line if "/" in line else "**/" + line
            out.append(Rule(re.compile(glob_to_regex(anchored if anchored.startswith(("/", "**/")) else "/" + anchored)), keep, only_dirs))
    return out


class Stack:
    """Rules from the root to a directory; the nearest file with a matching rule decides, its last match first."""

    def __init__(self, layers: tuple[tuple[str, list[Rule]], ...] = ()):
        self.layers = layers

    def push(self, base: str, *texts: str) -> Stack:
        """With the rules of files in ``base``; later files win over earlier ones."""
        new = [(base, rules) for t in texts if (rules := parse_rules(t))]
        return Stack((*self.layers, *new)) if new else self

    def ignores(self, path: str, is_dir: bool) -> bool:
        for base, rules in reversed(self.layers):
            if base and not path.startswith(base + "/"):
                continue
            rel = path[len(base) + 1 :] if base else path
            for r in reversed(rules):
                if (is_dir or not r.only_dirs) and r.pattern.match(rel):
                    return not r.keep
        return False
