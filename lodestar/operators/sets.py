"""Relational division and bounded reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import materialize


def divide(have: DataFrame, need: DataFrame, keys: list[str], on: str) -> DataFrame:
    """The keys of ``have`` (keys, on) that go with every value of ``need`` (on).

    Both sides are reduced to distinct pairs and counted; the size of ``need`` comes along as a one-row column.
    """
    want = need.select(on).distinct()
    met = have.select(*keys, on).distinct().join(want, on, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("met"))
    size = want.agg(F.count(F.lit(1)).alias("size")).first()["size"]
    return met.where(F.col("met") == size).select(*keys)


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, level): nodes within ``depth`` steps over edges (a, b), each at its least level.

    Every round joins the frontier with the edges and drops what was visited.  The edges and each round's nodes are
    written once, which cuts the lineage; nothing is collected.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    frontier = seen = materialize(start.select("node").distinct().withColumn("level", F.lit(0)), "level")
    for level in range(1, depth + 1):
        new = edges.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = materialize(new.join(seen, "node", "left_anti").withColumn("level", F.lit(level)), "level")
        seen = seen.unionByName(frontier)
    return seen
