"""Text functions: lines, names, sizes, digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_array(content: Column) -> Column:
    """The lines of a text: a final newline makes no further line, and an empty text has none."""
    body = F.when(F.endswith(content, F.lit("\n")), F.left(content, F.char_length(content) - 1)).otherwise(content)
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def line_count(content: Column) -> Column:
    n = F.regexp_count(content, F.lit("\n"))
    return F.when(content == "", 0).when(F.endswith(content, F.lit("\n")), n).otherwise(n + 1).cast("int")


def shown(line: Column) -> Column:
    """A line without its carriage return, as it is displayed (matching sees it)."""
    return F.regexp_replace(line, r"\r$", "")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def segments(name: Column) -> Column:
    """The parts of a qualified name, at ``::``, ``.``, ``#`` or ``/``."""
    return F.filter(F.split(name, r"::|[.#/]"), lambda s: s != "")


def last_segment(name: Column) -> Column:
    return F.element_at(segments(name), -1)


def strip_selector(name: Column) -> Column:
    """A selector's head: what stands before the first colon."""
    return F.substring_index(name, ":", 1)


def strip_generics(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[<\[].*$", ""))


def type_base_name(name: Column) -> Column:
    """The bare name of a type: without references, generics and qualifiers."""
    return last_segment(strip_generics(F.regexp_replace(name, r"^[&*\s]+", "")))


def human_bytes(n: Column) -> Column:
    unit = lambda size, name: F.concat(F.format_number(n / F.lit(size), 1), F.lit(name))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(1024, " KB")).when(n < 1 << 30, unit(1 << 20, " MB")).otherwise(unit(1 << 30, " GB"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def plural(n: int, noun: str) -> str:
    if n == 1:
        return f"1 {noun}"
    return f"{n:,} {noun}{'es' if noun.endswith(('ch', 'sh', 's', 'x')) else 's'}"


def is_etag(text: Column) -> Column:
    return F.rlike(text, F.lit("^[0-9A-Fa-f]{16}$"))


def clip_bytes(text: str, most: int) -> str:
    """At most ``most`` bytes of a text, cut between characters, with an ellipsis if cut."""
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "…"


def proximity(a: str, b: str) -> int:
    """Leading path components that two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def shared_components(a: Column, b: Column) -> Column:
    """``proximity`` of two columns of paths."""
    x, y = F.split(a, "/"), F.split(b, "/")
    least = F.least(F.size(x), F.size(y))
    differs = F.array_position(F.zip_with(F.slice(x, F.lit(1), least), F.slice(y, F.lit(1), least), lambda p, q: p != q), True)
    return F.when(differs > 0, differs - 1).otherwise(least).cast("int")


def clip_utf8(text: Column, most: int) -> Column:
    """At most ``most`` bytes of a text, cut on the border of a character."""
    raw = F.encode(text, "utf-8")
    goes_on = lambda n: F.substring(raw, n + 1, 1).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    at = F.when(~goes_on(most), most).when(~goes_on(most - 1), most - 1).when(~goes_on(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), at).cast("string"))


def byte_levenshtein(a: str, b: str) -> int:
    """Edit distance in bytes; a large number where the lengths differ by more than 8."""
    x, y = a.encode(), b.encode()
    if abs(len(x) - len(y)) > 8:
        return 1 << 30
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def distance(a: Column, b: str) -> Column:
    """``byte_levenshtein`` to a fixed text: built in for ASCII, by UDF where bytes and characters differ."""
    if b.isascii():
        fast = F.when(F.abs(F.octet_length(a) - len(b)) > 8, F.lit(1 << 30)).otherwise(F.levenshtein(a, F.lit(b)))
        return F.when(F.octet_length(a) == F.char_length(a), fast).otherwise(_distance_udf(b)(a))
    return _distance_udf(b)(a)


def _distance_udf(b: str):
    @F.pandas_udf(T.IntegerType())
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda x: byte_levenshtein(x, b))

    return run


@F.pandas_udf(T.StringType())
def etag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """XXH3-64 of a text's bytes as 16 hexadecimal digits (null of null)."""
    import xxhash

    for texts in batches:
        yield texts.map(lambda t: None if t is None else xxhash.xxh3_64_hexdigest(t.encode("utf-8", "surrogatepass")))
