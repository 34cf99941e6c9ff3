"""Symbols of every text: the table function that the other operators stand on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import code, structured
from lodestar.operators.symbols import SYMBOLS, Symbol, rows
from lodestar.session import ship_code
from lodestar.sources.decode import PARSE_LIMIT

FIELDS = [c.split(" ")[0] for c in SYMBOLS.replace("struct<start:int,end:int>", "struct").split(", ")]


def outline(text: str, lang: str | None) -> list[Symbol]:
    """The symbols of one text; one that can't be read has none."""
    try:
        if lang in structured.SCANNERS:
            return structured.SCANNERS[lang](text)
        return code.outline(text, lang) if lang else []
    except (RecursionError, IndexError, ValueError):
        return []


def parsed(content: str) -> bool:
    """Whether a text is short enough, in bytes, to be read for symbols."""
    return 4 * len(content) <= PARSE_LIMIT or len(content) <= PARSE_LIMIT and len(content.encode("utf-8", "replace")) <= PARSE_LIMIT


def passed_over(sources: DataFrame) -> DataFrame:
    """(path, bytes): the texts in a known language that are too long to be read for symbols."""
    return sources.where(F.col("lang").isNotNull() & (F.octet_length("content") > PARSE_LIMIT)).select("path", F.octet_length("content").cast("long").alias("bytes"))


def extract(sources: DataFrame) -> DataFrame:
    """(path, lang, symbol fields) from sources (path, lang, content), text by text."""
    ship_code(sources.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, lang, content in zip(b["path"], b["lang"], b["content"]):
                if content and lang and parsed(content):
                    for r in rows(outline(content, lang)):
                        collapse = None if r[8] is None else {"start": r[8][0], "end": r[8][1]}
                        out.append((path, lang, *r[:8], collapse, *r[9:]))
            got = pd.DataFrame(out, columns=["path", "lang", *FIELDS])
            got["parent"] = got["parent"].astype("Int32")
            yield got

    return sources.where(F.col("lang").isNotNull()).select("path", "lang", "content").mapInPandas(run, f"path string, lang string, {SYMBOLS}")


def innermost(points: DataFrame, symbols: DataFrame, keys: list[str], line: str = "line", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``points`` with the innermost symbol around their line as ``owner_idx`` (null outside all symbols).

    A containment join: equal path, line between start and end; the deepest symbol wins, the first on a tie.  The
    path is always an equi key, so the plan is a hash or sort-merge join with a residual condition, and AQE
    splits a path that holds much of either side.
    """
    s = symbols.where(F.col("kind").isin(*kinds)) if kinds else symbols
    s = s.select(F.col("path").alias("_path"), F.col("idx").alias("_idx"), F.col("depth").alias("_depth"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    met = points.join(s, (F.col("path") == F.col("_path")) & F.col(line).between(F.col("_start"), F.col("_end")), "left")
    rest = [c for c in points.columns if c not in keys]
    best = F.max_by("_idx", F.struct(F.col("_depth"), -F.col("_idx")))
    return met.groupBy(*keys).agg(best.alias("owner_idx"), *[F.first(c).alias(c) for c in rest])
