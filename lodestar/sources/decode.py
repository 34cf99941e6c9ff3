"""Bytes to text: byte-order marks, UTF-16, binary and line-end tests, and what a binary file is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import ship_code

# How much of a file each test sees, and the largest text that is held as one.
BINARY_HEAD, CRLF_HEAD, MEMORY_LIMIT, PARSE_LIMIT, SEARCH_LIMIT, GROUP_LIMIT = 8 << 10, 64 << 10, 64 << 20, 8 << 20, 256 << 20, 1 << 20
# The first bytes (hexadecimal, from an offset) of kinds of binary files.
MAGIC = (
    ("PNG image", 0, "89504E470D0A1A0A"),
    ("JPEG image", 0, "FFD8FF"),
    ("GIF image", 0, "47494638"),
    ("WebP image", 8, "57454250"),
    ("PDF document", 0, "25504446"),
    ("ZIP archive (or jar/docx/xlsx)", 0, "504B0304"),
    ("gzip data", 0, "1F8B"),
    ("SQLite database", 0, "53514C69746520666F726D6174203300"),
    ("Mach-O binary", 0, "CFFAEDFE"),
    ("Mach-O binary", 0, "CEFAEDFE"),
    ("Mach-O universal binary (or Java class)", 0, "CAFEBABE"),
    ("ELF binary", 0, "7F454C46"),
    ("binary property list", 0, "62706C6973743030"),
    ("WebAssembly module", 0, "0061736D"),
    ("MP4/QuickTime media", 4, "66747970"),
    ("web font", 0, "774F4646"),
    ("web font", 0, "774F4632"),
    ("font file", 0, "00010000"),
    ("font file", 0, "4F54544F"),
)
DECODED = "content string, binary boolean, bom boolean, utf16 boolean, crlf boolean, lossy boolean"


def decode(raw: bytes | None) -> tuple[str | None, bool, bool, bool, bool, bool]:
    """(content, binary, bom, utf16, crlf, lossy) of a file's bytes; binary files have no content."""
    if raw is None:
        return None, False, False, False, False, False
    bom = utf16 = False
    if raw[:3] == b"\xef\xbb\xbf":
        raw, bom = raw[3:], True
    elif raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raw, bom, utf16 = raw[2:].decode("utf-16-le" if raw[:1] == b"\xff" else "utf-16-be", "replace").encode(), True, True
    if not utf16 and b"\0" in raw[:BINARY_HEAD]:
        return None, True, bom, False, False, False
    try:
        text, lossy = raw.decode(), False
    except UnicodeDecodeError:
        text, lossy = raw.decode("utf-8", "replace"), True
    return text, False, bom, utf16, b"\r\n" in raw[:CRLF_HEAD], lossy


def decoded(files: DataFrame, raw: str = "raw") -> DataFrame:
    """``files`` with its bytes decoded; one row at a time in Arrow batches."""
    ship_code(files.sparkSession)
    keep = [f for f in files.schema.fields if f.name != raw]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([decode(x) for x in b[raw]], columns=[c.split()[0] for c in DECODED.split(", ")], index=b.index)
            yield pd.concat([b[[f.name for f in keep]], got], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return files.mapInPandas(rows, f"{schema}, {DECODED}")


def describe_binary(raw: Column) -> Column:
    """What kind of binary file begins with these bytes."""
    out = F.lit("binary data")
    for name, at, magic in reversed(MAGIC):
        hit = F.hex(F.substring(raw, at + 1, len(magic) // 2)) == magic
        if name == "WebP image":
            hit = hit & (F.hex(F.substring(raw, 1, 4)) == "52494646")
        out = F.when(hit, name).otherwise(out)
    return out
