"""The symbol record, and what every extractor shares."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Kinds by what can be done with them.
CALLABLE = ("function", "method", "constructor", "test", "macro")
TYPE_LIKE = ("class", "struct", "interface", "trait", "enum", "type", "impl", "module", "object")
LABEL_LIMIT, HEADING_LIMIT = 180, 120

SYMBOLS = "idx int, name string, qualified string, scope string, kind string, start int, end int, def int, collapse struct<start:int,end:int>, parent int, depth int, signature string"


@dataclass
class Symbol:
    """Lines are counted from 1; ``start`` takes in documentation, ``line`` is that of the definition itself."""

    name: str
    kind: str
    start: int
    line: int
    end: int
    label: str
    scope: str | None = None
    collapse: tuple[int, int] | None = None
    parent: int | None = None
    depth: int = 0
    level: int = 0


def squash(text: str) -> str:
    return " ".join(text.split())


def clip(text: str, most: int) -> str:
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "…"


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a final newline makes no further one."""
    got = text.split("\n")
    if got and got[-1] == "":
        got.pop()
    return [x[:-1] if x.endswith("\r") else x for x in got]


def qualified(symbols: list[Symbol], i: int) -> str:
    """The names from the outermost ancestor down, each with its scope before it."""
    parts, at = [], i
    while at is not None:
        s = symbols[at]
        parts.append(s.name)
        if s.scope:
            parts.extend(reversed([p for p in re.split(r"::|[.#/]", s.scope) if p]))
        at = s.parent
    return ".".join(reversed(parts))


def rows(symbols: list[Symbol]) -> list[tuple]:
    """Records in the order of ``SYMBOLS``."""
    return [(i, s.name, qualified(symbols, i), s.scope, s.kind, s.start, s.end, s.line, s.collapse, s.parent, s.depth, s.label) for i, s in enumerate(symbols)]


def nest_by_level(symbols: list[Symbol], lines: list[str]) -> None:
    """Parents and depths by level; a symbol ends before the next one at its level or above, without blank lines."""
    open_: list[int] = []
    for i, s in enumerate(symbols):
        while open_ and symbols[open_[-1]].level >= s.level:
            symbols[open_.pop()].end = s.start - 1
        s.parent, s.depth = (open_[-1] if open_ else None), len(open_)
        open_.append(i)
    for i in open_:
        symbols[i].end = len(lines)
    for s in symbols:
        s.end = max(s.end, s.start)
        while s.end > s.start and not lines[s.end - 1].strip():
            s.end -= 1
