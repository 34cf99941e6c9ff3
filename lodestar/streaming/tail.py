"""Streams of growing texts: each text's new lines as its versions arrive.

The state of a path is what was shown of it last: its length, the digest of that much, and its number of lines.
A version that goes on from there gives its new lines; any other gives all of them again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NEW_LINES = "path string, change string, line int, text string"
_STATE = "size long, digest string, lines int"


def _lines(text: str) -> list[str]:
    got = text.split("\n")
    return got[:-1] if got[-1] == "" else got


def _tail(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (path,) = key
    size, digest, seen = state.get if state.exists else (0, None, 0)
    for b in batches:
        for content in b.sort_values("version")["content"]:
            raw = content.encode()
            same = digest is not None and len(raw) >= size and hashlib.sha1(raw[:size]).hexdigest() == digest
            if same and len(raw) == size:
                continue
            change = "added" if digest is None else "appended" if same else "edited"
            lines = _lines(content)
            # a last line without its end is shown again when it grows
            first = seen - (1 if raw[:size] and not raw[:size].endswith(b"\n") else 0) if same else 0
            yield pd.DataFrame([(path, change, i + 1, t) for i, t in enumerate(lines) if i >= first], columns=["path", "change", "line", "text"])
            size, digest, seen = len(raw), hashlib.sha1(raw).hexdigest(), len(lines)
    state.update((size, digest, seen))


def tail(versions: DataFrame) -> DataFrame:
    """New lines of a stream of versions (path, version, content)."""
    return versions.groupBy("path").applyInPandasWithState(_tail, NEW_LINES, _STATE, "append", GroupStateTimeout.NoTimeout)
