"""The block around a line of a text without an outline: by indentation and closing lines."""

from __future__ import annotations

import re

LONGEST = 400
_CLOSER = re.compile(r"^\s*(?:[)\]}]+[;,)]*|(?:end|fi|done|esac|@end)\b)\s*[;,)]*\s*$")
_CLAUSE = re.compile(r"^\s*(?:[})\]]*\s*)?(?:else|elif|elsif|elseif|except|catch|finally|rescue|ensure|when|case|default|then)\b")
_COMMENT = re.compile(r"^\s*(?://|#(?!\s*(?:include|define|if|endif))|/\*|\*|--|;;)")
_DEFINITION = re.compile(
    r"^\s*(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|internal|static|async|abstract|final|override|local|inline|unsafe|extern|const)\s+)*"
    r"(?:def|fn|func|function|class|struct|interface|trait|enum|impl|module|namespace|sub|proc|procedure|object|record|protocol|extension|type)\b|"
    r"(?:=>|\bfunction\b[^()]*\([^()]*\))\s*\{?\s*$|^\s*[\w:]+\s*\(\s*\)\s*\{|^[A-Za-z_][\w\s*&:<>,]*\s[*&]?[\w:~]+\s*\([^;]*$"
)


def width(line: str) -> int:
    """The column of a line's first character; a tab goes to the next multiple of 4."""
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def shape(line: str) -> str:
    """blank, comment, closer, clause or code."""
    if not line.strip():
        return "blank"
    for name, pattern in (("comment", _COMMENT), ("closer", _CLOSER), ("clause", _CLAUSE)):
        if pattern.match(line):
            return name
    return "code"


def balance(line: str) -> int:
    return sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")


def _first(lines: list[str], i: int) -> int:
    """The line on which the statement of line ``i`` begins: a line that is left of it or starts afresh."""
    while i > 0 and shape(lines[i]) in ("closer", "clause"):
        j = i - 1
        while j > 0 and (shape(lines[j]) == "blank" or width(lines[j]) > width(lines[i])):
            j -= 1
        if width(lines[j]) > width(lines[i]):
            break
        i = j
    return i


def _last(lines: list[str], i: int) -> int:
    """The last line of the block that line ``i`` opens: deeper lines, its clauses, and its closing line."""
    here, end = width(lines[i]), i
    for j in range(i + 1, len(lines)):
        kind = shape(lines[j])
        if kind == "blank":
            continue
        w = width(lines[j])
        if w > here:
            end = j
        elif w == here and (kind == "clause" or kind == "code" and lines[j].strip() == "{"):
            end = j
        elif w == here and kind == "closer":
            return j
        else:
            break
    return end


def _documented(lines: list[str], i: int) -> int:
    while i > 0 and (shape(lines[i - 1]) == "comment" or re.match(r"\s*(?:@\w|#\[|\[\w)", lines[i - 1])) and width(lines[i - 1]) <= width(lines[i]) + 1:
        i -= 1
    return i


def enclosing(lines: list[str], line: int) -> tuple[int, int] | None:
    """(first, last), from 1, of the innermost definition around a line, else of the outermost statement; None if that
    has ``LONGEST`` lines or more or is nothing but the line itself."""
    if not 1 <= line <= len(lines):
        return None
    at = line - 1
    while at > 0 and shape(lines[at]) == "blank":
        at -= 1
    outer, found, i = None, None, _first(lines, at)
    limit = width(lines[i]) + 1
    while i >= 0:
        if shape(lines[i]) == "code" and width(lines[i]) < limit:
            last = _last(lines, i)
            if last >= at:
                outer = (i, last)
                if found is None and _DEFINITION.search(lines[i]) and (last > i or i == at):
                    found = (i, last)
                    break
            limit = width(lines[i])
            if not limit:
                break
        i -= 1
    best = found or outer
    if best is None or best[1] - best[0] + 1 >= LONGEST or best[0] == best[1] and found is None:
        return None
    return _documented(lines, best[0]) + 1, best[1] + 1
