"""Search: lines that match a pattern, by line, by enclosing symbol or by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions.regex import glob_filter, matches
from lodestar.functions.text import clip_utf8, line_array, shown
from lodestar.operators.outline import innermost
from lodestar.operators.running import running
from lodestar.sources.languages import searchable

# Hits kept a file, context lines at most, hits in all, and bytes of a shown line.
FILE_HITS, MAX_CONTEXT, MAX_MATCHES, MAX_RECORDS, TEXT_CLIP, LINE_CLIP, LINE_LEAD = 400, 10, 5000, 1_000_000, 1000, 300, 100


def explode_lines(sources: DataFrame) -> DataFrame:
    """(path, line, text): the lines of every text, counted from 1, carriage returns kept."""
    return sources.select("path", F.posexplode(line_array(F.col("content"))).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def hits(sources: DataFrame, pattern: str, *, literal: bool = False, word: bool = False, case: str = "smart", globs: list[str] | None = None, paths: list[str] | None = None, large: DataFrame | None = None) -> DataFrame:
    """(path, line, text) of the matching lines; ``large`` holds the lines of texts that are no rows of ``sources``.

    A text without any match is dropped before its lines are made: a match of a line is a match of its text for
    patterns without anchors, and the line filter decides in any case.
    """
    wanted = searchable(F.col("path"))
    if globs:
        wanted = wanted & glob_filter(F.col("path"), globs)
    if paths:
        under = F.lit(False)
        for p in paths:
            under = under | (F.col("path") == p) | F.startswith(F.col("path"), F.lit(p.rstrip("/") + "/"))
        wanted = wanted & under
    s = sources.where(F.col("content").isNotNull() & wanted)
    if literal and not word:
        s = s.where(matches(F.col("content"), pattern, True, False, case))
    lines = explode_lines(s)
    if large is not None:
        lines = lines.unionByName(large.where(wanted))
    return lines.where(matches(F.col("text"), pattern, literal, word, case))


def limited(found: DataFrame, max_matches: int = MAX_MATCHES, file_hits: int = FILE_HITS) -> DataFrame:
    """Hits with ``kept``: within each file's first ``file_hits``, and in files before which fewer than ``max_matches``
    matches stand in path order (the file that crosses the limit is kept whole)."""
    by_file = found.groupBy("path").agg(F.count(F.lit(1)).alias("matches"))
    before = running(by_file, ["path"], "matches").select("path", "matches", (F.col("upto_matches") - F.col("matches")).alias("before"))
    n = F.row_number().over(W.partitionBy("path").orderBy("line"))
    return found.withColumn("n", n).join(before, "path").withColumn("kept", (F.col("n") <= file_hits) & (F.col("before") < max_matches)).drop("n")


def files(found: DataFrame) -> DataFrame:
    """(path, matches)."""
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("matches"))


def context(found: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """(path, line, text, is_match): the hits and ``n`` lines around each, every line once."""
    n = max(0, min(n, MAX_CONTEXT))
    around = found.select("path", F.col("line").alias("hit"), F.explode(F.sequence(F.greatest(F.col("line") - n, F.lit(1)), F.col("line") + n)).alias("line"))
    want = around.groupBy("path", "line").agg(F.max(F.col("hit") == F.col("line")).alias("is_match"))
    return lines.join(want, ["path", "line"]).select("path", "line", "text", "is_match")


def by_symbol(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, owner_idx, matches, lines): hits by innermost enclosing symbol; a null owner is the text itself."""
    own = innermost(found.select("path", "line"), symbols, ["path", "line"])
    return own.groupBy("path", "owner_idx").agg(F.count(F.lit(1)).alias("matches"), F.sort_array(F.collect_list("line")).alias("lines"))


def clip_around(text: Column, pattern: Column) -> Column:
    """A shown line: at most ``LINE_CLIP`` characters, from ``LINE_LEAD`` before the match."""
    at = F.greatest(F.regexp_instr(text, pattern) - LINE_LEAD, F.lit(1))
    return F.when(F.octet_length(text) <= LINE_CLIP, text).otherwise(F.concat(F.when(at > 1, "…").otherwise(""), F.substring(text, at, F.lit(LINE_CLIP)), F.lit("…")))


def match_records(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, text, clipped, symbol, symbol_lines): one record a hit, for JSON Lines."""
    own = innermost(found.select("path", "line", "text"), symbols, ["path", "line"])
    s = symbols.select("path", F.col("idx").alias("owner_idx"), F.col("qualified").alias("symbol"), F.array("start", "end").alias("symbol_lines"))
    text = shown(F.col("text"))
    rows = own.join(s, ["path", "owner_idx"], "left")
    return rows.select("path", "line", clip_utf8(text, TEXT_CLIP).alias("text"), F.when(F.octet_length(text) > TEXT_CLIP, True).alias("clipped"), "symbol", "symbol_lines")


def symbol_records(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, symbol, matches, lines): one record an enclosing symbol, which is null at the top level."""
    s = symbols.select("path", F.col("idx").alias("owner_idx"), F.struct("path", "name", "qualified", "kind", "start", "end", "def", "depth", "signature").alias("symbol"))
    return by_symbol(found, symbols).join(s, ["path", "owner_idx"], "left").select("path", "symbol", "matches", "lines")


def summary(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(files_searched, files_matched, matches)."""
    per = files(found).agg(F.count(F.lit(1)).alias("files_matched"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.lit(1).alias("one"))
    every = sources.where(searchable(F.col("path"))).agg(F.count(F.lit(1)).alias("files_searched"), F.lit(1).alias("one"))
    return every.join(per, "one").drop("one")
