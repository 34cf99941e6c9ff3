"""A table-driven lexer: blanks out comments and strings, so that what remains is code.

Every character keeps its place (newlines stay), so positions in the mask are positions in the text.  Code
inside the interpolations of strings stays code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Style:
    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: tuple[str, ...] = ('"', "'")
    long_quotes: tuple[str, ...] = ()
    interpolation: tuple[tuple[str, str, str], ...] = ()  # (quote, opener, closer)
    char: str = ""  # a quote that may also begin something that is no string (a lifetime, say)


C_LIKE = Style()
STYLES = {
    "rust": Style(quotes=('"',), char="'"),
    "python": Style(line=("#",), block=(), long_quotes=('"""', "'''"), interpolation=()),
    "javascript": Style(quotes=('"', "'", "`"), interpolation=(("`", "${", "}"),)),
    "typescript": Style(quotes=('"', "'", "`"), interpolation=(("`", "${", "}"),)),
    "tsx": Style(quotes=('"', "'", "`"), interpolation=(("`", "${", "}"),)),
    "go": Style(quotes=('"', "'", "`")),
    "java": Style(long_quotes=('"""',)),
    "c": C_LIKE,
    "cpp": C_LIKE,
    "objc": C_LIKE,
    "csharp": Style(long_quotes=('"""',), interpolation=(('"', "{", "}"),)),
    "php": Style(line=("//", "#"), interpolation=()),
    "swift": Style(quotes=('"',), long_quotes=('"""',), interpolation=(('"', "\\(", ")"),)),
    "kotlin": Style(long_quotes=('"""',), interpolation=(('"', "${", "}"),)),
    "scala": Style(long_quotes=('"""',), interpolation=()),
    "bash": Style(line=("#",), block=(), interpolation=(('"', "$(", ")"),)),
    "ruby": Style(line=("#",), block=(("=begin", "=end"),), interpolation=(('"', "#{", "}"),)),
    "lua": Style(line=("--",), block=(("--[[", "]]"),), long_quotes=("[[",)),
    "luau": Style(line=("--",), block=(("--[[", "]]"),), long_quotes=("[[",), quotes=('"', "'", "`"), interpolation=(("`", "{", "}"),)),
}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def mask(text: str, lang: str) -> str:
    """``text`` with comments and strings (but not their interpolated code) as blanks."""
    style = STYLES.get(lang, C_LIKE)
    inter = {q: (o, c) for q, o, c in style.interpolation}
    marks = sorted({*style.line, *(a for a, _ in style.block), *style.quotes, *style.long_quotes, *([style.char] if style.char else [])}, key=len, reverse=True)
    seek = re.compile("|".join(map(re.escape, marks)))
    out, at, n = [], 0, len(text)
    closers = {a: b for a, b in style.block}
    while at < n:
        m = seek.search(text, at)
        if not m:
            break
        out.append(text[at : m.start()])
        at, mark = m.start(), m.group()
        if mark in closers:
            end = text.find(closers[mark], at + len(mark))
            end = n if end < 0 else end + len(closers[mark])
        elif mark in style.line:
            if mark == "#" and lang in ("bash", "php") and at and not text[at - 1].isspace():
                end = at + 1  # $# or ${x#y}
                out.append(mark)
                at = end
                continue
            end = text.find("\n", at)
            end = n if end < 0 else end
        elif mark == style.char:
            lit = re.compile(r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'").match(text, at)
            if not lit:
                out.append(mark)
                at += 1
                continue
            end = lit.end()
        elif mark in style.long_quotes:
            closer = "]]" if mark == "[[" else mark
            end = text.find(closer, at + len(mark))
            end = n if end < 0 else end + len(closer)
        else:
            piece, end = _string(text, at, mark, inter.get(mark), lang)
            out.append(piece)
            at = end
            continue
        out.append(_blank(text[at:end]))
        at = end
    out.append(text[at:])
    return "".join(out)


def _string(text: str, at: int, quote: str, inter: tuple[str, str] | None, lang: str) -> tuple[str, int]:
    """(mask, end) of a string that begins at ``at``; one that isn't closed ends with its line, unless it may go on."""
    out, i, n = [" "], at + 1, len(text)
    spans_lines = quote == "`" or lang in ("bash", "php", "ruby", "rust")
    while i < n:
        c = text[i]
        if c == quote:
            return "".join(out) + " ", i + 1
        if inter and text.startswith(inter[0], i):
            depth, j, opener = 1, i + len(inter[0]), inter[0][-1]
            while j < n and depth:
                depth += (text[j] == opener) - (text[j] == inter[1])
                j += 1
            out.append(" " * len(inter[0]) + (mask(text[i + len(inter[0]) : j - 1], lang) + " " if not depth else text[i + len(inter[0]) : j]))
            i = j
            continue
        if c == "\\" and not (quote == "`" and lang == "go"):
            out.append(_blank(text[i : i + 2]))
            i += 2
            continue
        if c == "\n" and not spans_lines:
            return "".join(out), i
        out.append("\n" if c == "\n" else " ")
        i += 1
    return "".join(out), n
