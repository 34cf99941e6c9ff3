"""User patterns for Spark's regular expressions.

Patterns follow a linear-time dialect: Unicode-aware classes and case folding, ``.`` and ``$`` that know ``\\n``
only, and neither look-around nor back-references, which Java would accept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

class PatternError(ValueError):
    """A pattern that can't be used, with advice."""


def escape(text: str) -> str:
    """``text`` quoted as a whole for Spark's patterns; where it holds the end of a quotation, that is quoted by itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _strip_classes(pattern: str) -> str:
    """The pattern without escaped characters and character classes, for looking at its structure."""
    return re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", "", re.sub(r"\\[^1-9k]", "", pattern))


def is_insensitive(pattern: str, case: str, literal: bool = False) -> bool:
    """Whether case is folded: always, never, or (smart) where the pattern has no upper-case letter."""
    if case == "insensitive":
        return True
    if case == "sensitive":
        return False
    if case != "smart":
        raise PatternError(f"case must be smart, sensitive or insensitive, not {case!r}")
    seen = pattern if literal else re.sub(r"\\(?:[pP]\{[^}]*\}|.)", "", pattern)
    return not any(c.isupper() for c in seen)


def compile_pattern(pattern: str, literal: bool = False, word: bool = False, case: str = "smart") -> str:
    """The Java pattern for a user's pattern; raises ``PatternError`` for what the dialect lacks."""
    body = escape(pattern) if literal else pattern
    if not literal:
        bare = _strip_classes(pattern)
        if re.search(r"\(\?<?[=!]", bare):
            raise PatternError("look-around is not supported; try literal=true if the text is meant literally")
        if re.search(r"\\[1-9]|\\k", bare):
            raise PatternError("back-references are not supported; try literal=true if the text is meant literally")
        try:
            re.compile(re.sub(r"\(\?P?<", "(?P<", re.sub(r"\\[pP]\{[^}]*\}|\\[hHRXzGQE]", "x", pattern)))
        except re.error as e:
            raise PatternError(f"invalid pattern: {e}; try literal=true if the text is meant literally") from e
    if word:
        body = rf"(?<!\w)(?:{body})(?!\w)"
    return f"(?d{'i' if is_insensitive(pattern, case, literal) else ''}U)" + body


def matches(text: Column, pattern: str, literal: bool = False, word: bool = False, case: str = "smart") -> Column:
    """Whether a line holds the pattern; a plain case-sensitive literal needs no regular expression."""
    if literal and not word and not is_insensitive(pattern, case, True):
        return F.contains(text, F.lit(pattern))
    return F.rlike(text, F.lit(compile_pattern(pattern, literal, word, case)))


def no_match_advice(pattern: str, literal: bool, case: str) -> str:
    """What to try when nothing matched."""
    tips = []
    if not is_insensitive(pattern, case, literal):
        tips.append("case=insensitive")
    if not literal and any(c in pattern for c in "\\.+*?()|[]{}^$"):
        tips.append("literal=true")
    return "no matches" + (f"; try {' or '.join(tips)}" if tips else "")


def glob_to_regex(glob: str) -> str:
    """A path glob as an anchored pattern: ``*`` and ``?`` stay within a segment, ``**`` crosses them, ``{a,b}``
    and ``[...]`` as usual; a glob without a slash matches in any directory."""
    body = glob.removeprefix("/")
    if "/" not in glob:
        body = "**/" + body
    out, i, depth = [], 0, 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if body.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out.append(re.escape(body[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + ")" * depth + "$"


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[{")


def glob_filter(path: Column, globs: list[str]) -> Column:
    """Paths that some plain glob matches (if there is any) and that no ``!`` glob matches; the last match wins."""
    keep = F.lit(not any(not g.startswith("!") for g in globs))
    for g in globs:
        hit = F.rlike(path, F.lit(glob_to_regex(g.removeprefix("!"))))
        keep = F.when(hit, F.lit(not g.startswith("!"))).otherwise(keep)
    return keep
