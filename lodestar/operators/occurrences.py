"""Names in code: where they stand, whether they are called, and on what."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.lexer import STYLES, mask
from lodestar.session import ship_code
from lodestar.operators.outline import parsed

OCCURRENCES = "path string, lang string, line int, col int, name string, kind string, qualifier string"
# Words that are no names.
KEYWORDS = frozenset(
    "if else for while do switch case break continue return function func fn def class struct enum trait interface impl type let var const static public private protected internal "
    "final abstract override new delete try catch finally throw throws raise except import from use package module namespace in is not and or elif end then begin rescue ensure unless "
    "until yield await async match where mut pub mod crate extends implements true false null nil None True False void int float double bool char string with as pass lambda global "
    "nonlocal assert del go defer select chan range map interface fallthrough goto typeof instanceof of get set static_cast sizeof template typename using virtual inline extern register "
    "signed unsigned short long auto operator friend this self super Self cls".split()
)
_NAME = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*[?!]?")
_CALL = re.compile(r"\s*(?:\(|::<[^()<>]*(?:<[^<>]*>)?[^()<>]*>\s*\(|<[\w\s,.:\[\]]*>\(|!\s*[(\[{])")
_BEFORE = re.compile(r"([\w$)\]?]?)(\s*(?:\?\.|->|::|\.|:)\s*)$")
_IMPORT = re.compile(r"\s*(?:(?:pub(?:\([^)]*\))?\s+)?use\b|import\b|from\b|#\s*(?:include|import)\b|@import\b|require\b|require_relative\b|using\b|(?:const|let|var|local)\b.*\brequire\s*\(|(?:const|let|var)\b.*\bimport\s*\()")


def qualifier_before(code: str, at: int, lang: str) -> str | None:
    """What a name stands on: a word, the empty text for an expression, None for nothing."""
    m = _BEFORE.search(code, max(0, at - 200), at)
    if not m:
        return None
    joiner = m.group(2).strip()
    if joiner == ":" and lang not in ("lua", "luau", "objc"):
        return None
    word = re.search(r"([A-Za-z_$][\w$]*)(?:<[^<>]*>)?\??$", code[max(0, at - 200) : m.start(2)])
    return word.group(1) if word else ""


def occurrences(text: str, lang: str) -> list[tuple[int, int, str, str, str | None]]:
    """(line, column, name, kind, qualifier) of every name in code; lines and columns count from 1."""
    code, out, line, start = mask(text, lang), [], 1, 0
    for row in code.split("\n"):
        imported = bool(_IMPORT.match(row))
        for m in _NAME.finditer(row):
            name = m.group()
            if lang != "ruby":
                name = name.rstrip("?!")
            if name in KEYWORDS:
                continue
            after = m.start() + len(name)
            call = _CALL.match(code, start + after, start + after + 200) if lang == "rust" else re.compile(r"\s*(?:<[\w\s,.:\[\]]*>)?\(").match(row, after)
            if call is None and lang == "bash" and not row[: m.start()].strip():
                call = True
            kind = "import" if imported else "call" if call else "ref"
            out.append((line, m.start() + 1, name, kind, qualifier_before(row, m.start(), lang)))
        line, start = line + 1, start + len(row) + 1
    return out


def extract(sources: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Occurrences in all code texts; of some names only, if given (texts without them are not read)."""
    ship_code(sources.sparkSession)
    s = sources.where(F.col("lang").isin(*STYLES) & F.col("content").isNotNull())
    if names is not None:
        some = F.lit(False)
        for n in names:
            some = some | F.contains("content", F.lit(n))
        s = s.where(some)
    wanted = frozenset(names) if names is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, g, *o) for p, g, c in zip(b["path"], b["lang"], b["content"]) if parsed(c) for o in occurrences(c, g) if wanted is None or o[2] in wanted]
            yield pd.DataFrame(rows, columns=["path", "lang", "line", "col", "name", "kind", "qualifier"])

    return s.select("path", "lang", "content").mapInPandas(run, OCCURRENCES)
