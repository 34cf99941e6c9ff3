"""Token estimates from nine counts, tokenizer profiles, and budgets.

The counts are plain SQL expressions, so an estimate over a corpus stays in whole-stage code; the same counts
in Python serve the driver, where rendered answers are cut to their budget.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weight of each count in an estimate.
WEIGHTS = {
    "digits": 0.2309,
    "punct": 0.5142,
    "ws_runs": 0.1415,
    "newlines": 3.1389,
    "non_ascii": 1.8830,
    "words": 1.1830,
    "digit_runs": 1.3637,
    "case_breaks": 1.3540,
    "dense": 0.1716,
}
# Budgets in tokens.
DEFAULT_BUDGET, MAX_BUDGET, MIN_BUDGET, MAP_BUDGET, TRACE_BUDGET = 8000, 10_000, 200, 3000, 4000


class Profile(NamedTuple):
    bytes_per_token: float
    scale: float


# Bytes a token and scale of each tokenizer profile.
PROFILES = {"legacy": Profile(2.6, 1.0), "dense": Profile(2.6 / 1.4, 1.4), "sparse": Profile(3.6, 0.85)}


def features(text: Column) -> dict[str, Column]:
    """The nine counts of a text, by name."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/=_-]{16,})"), F.lit(1))
    dense = F.filter(runs, lambda r: F.rlike(r, F.lit("[A-Za-z]")) & F.rlike(r, F.lit("[0-9]")))
    return {
        "digits": F.char_length(text) - F.char_length(F.translate(text, "0123456789", "")),
        "punct": F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]|[A-Za-z0-9 \t\r\n]", "")),
        "ws_runs": count(r"[ \t\r]+"),
        "newlines": F.char_length(text) - F.char_length(F.translate(text, "\n", "")),
        "non_ascii": F.when(F.octet_length(text) == F.char_length(text), 0).otherwise(count(r"[^\x00-\x7F]")),
        "words": count(r"[A-Za-z]+"),
        "digit_runs": count(r"[0-9]+"),
        "case_breaks": count(r"[a-z][A-Z]"),
        "dense": F.aggregate(dense, F.lit(0), lambda n, r: n + F.char_length(r)),
    }


def estimate(text: Column, scale: float = 1.0) -> Column:
    """Estimated tokens of a text, rounded up."""
    total = F.lit(0.0)
    for name, count in features(text).items():
        total = total + count.cast("double") * F.lit(WEIGHTS[name])
    return F.ceil(total * F.lit(scale)).cast("long")


def count_python(text: str) -> dict[str, int]:
    """The nine counts on the driver."""
    return {
        "digits": len(re.findall(r"[0-9]", text)),
        "punct": len(re.sub(r"[^\x00-\x7F]|[A-Za-z0-9 \t\r\n]", "", text)),
        "ws_runs": len(re.findall(r"[ \t\r]+", text)),
        "newlines": text.count("\n"),
        "non_ascii": len(re.findall(r"[^\x00-\x7F]", text)),
        "words": len(re.findall(r"[A-Za-z]+", text)),
        "digit_runs": len(re.findall(r"[0-9]+", text)),
        "case_breaks": len(re.findall(r"[a-z][A-Z]", text)),
        "dense": sum(len(r) for r in re.findall(r"[A-Za-z0-9+/=_-]{16,}", text) if re.search("[A-Za-z]", r) and re.search("[0-9]", r)),
    }


def estimate_python(text: str, scale: float = 1.0) -> int:
    return math.ceil(sum(WEIGHTS[k] * n for k, n in count_python(text).items()) * scale)


def clamp_budget(budget: int | None, default: int = DEFAULT_BUDGET, most: int = MAX_BUDGET) -> int:
    return max(MIN_BUDGET, min(budget if budget is not None else default, most))


def budget_bytes(budget: int, profile: Profile = PROFILES["legacy"]) -> int:
    return int(budget * profile.bytes_per_token)


def enforce(text: str, budget: int, scale: float = 1.0, notice: str = "[cut at the budget]") -> str:
    """``text`` cut at a line so that its estimate is within the budget and a twentieth, with room for a notice."""
    most = budget + budget // 20
    if estimate_python(text, scale) <= most:
        return text
    lines, low, high = text.split("\n"), 0, text.count("\n") + 1
    while low < high:  # the most lines that fit
        mid = (low + high + 1) // 2
        low, high = (mid, high) if estimate_python("\n".join(lines[:mid]) + "\n", scale) <= most - 40 else (low, mid - 1)
    return "\n".join([*lines[:low], notice])
