"""Budgets: how many blocks fit, in order, and fair shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators.running import running

LEAST_SHARE = 80


def prefix(blocks: DataFrame, size: str, most: int, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``blocks`` with ``kept``: the longest prefix in order whose sizes add up to ``most``; the first is always kept."""
    if within:
        w = W.partitionBy(*within).orderBy(*order)
        rows = blocks.withColumn("used", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w))
    else:
        rows = running(blocks, order, size, number="_rn").withColumnRenamed(f"upto_{size}", "used")
    # sizes may be 0 or more, so the sums rise and the first overflow ends the prefix
    return rows.withColumn("kept", (F.col("used") <= most) | (F.col("_rn") == 1)).drop("_rn")


def omitted(blocks: DataFrame) -> DataFrame:
    """What a prefix left out."""
    return blocks.where(~F.col("kept"))


def fair_shares(costs: list[int], budget: int) -> list[int]:
    """What each item may cost, smallest first: an equal share of what is left; less than ``LEAST_SHARE`` is nothing."""
    shares, left = [0] * len(costs), budget
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    for k, i in enumerate(order):
        share = left // (len(order) - k)
        shares[i] = costs[i] if costs[i] <= share else share if share >= LEAST_SHARE else 0
        left -= shares[i]
    return shares


def degrade(ladders: list[list[int]], tiers: list[int], budget: int) -> list[int]:
    """The view chosen for each item from its ladder of costs, best view first: the item of the lowest tier that costs
    most is lowered, again and again, until all fit or none can be lowered.  Steps that save less than a tenth
    are passed over; of equal costs the last item is lowered."""
    at = [0] * len(ladders)
    while sum(l[i] for l, i in zip(ladders, at)) > budget:
        can = [(-tiers[k], l[at[k]], k) for k, l in enumerate(ladders) if any(c <= 0.9 * l[at[k]] for c in l[at[k] + 1 :])]
        if not can:
            break
        k = max(can)[2]
        here = ladders[k][at[k]]
        at[k] = next(j for j in range(at[k] + 1, len(ladders[k])) if ladders[k][j] <= 0.9 * here)
    return at
