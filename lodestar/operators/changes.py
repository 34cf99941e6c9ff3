"""Versions: unchanged, appended and edited texts, line diffs, and what became of each symbol."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions.text import etag, line_count
from lodestar.operators.outline import innermost
from lodestar.operators.search import explode_lines
from lodestar.session import ship_code

# Lines of context in a hunk, and the share of a text (in tenths) above which it is shown whole.
DIFF_CONTEXT, WHOLE_ABOVE = 2, 7
HUNKS = "path string, hunk int, old_start int, old_lines int, new_start int, new_lines int, first_changed int, added int, removed int, body string"


def pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, old, new): texts of both versions, null where one lacks the path."""
    return before.select("path", F.col("content").alias("old")).join(after.select("path", F.col("content").alias("new")), "path", "full_outer")


def classify(both: DataFrame) -> DataFrame:
    """``pairs`` with ``change``: added, removed, unchanged, appended or edited."""
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").when(F.startswith("new", F.col("old")), "appended").otherwise("edited")
    return both.withColumn("change", kind)


def appended_lines(both: DataFrame) -> DataFrame:
    """(path, line, text): what appended texts gained; the last line anew if it had no end before."""
    rows = classify(both).where("change = 'appended'")
    seen = rows.select("path", (line_count(F.col("old")) - F.when((F.col("old") != "") & ~F.endswith("old", F.lit("\n")), 1).otherwise(0)).alias("seen"))
    return explode_lines(rows.select("path", F.col("new").alias("content"))).join(seen, "path").where("line > seen").drop("seen")


def diff_hunks(both: DataFrame, context: int = DIFF_CONTEXT) -> DataFrame:
    """Hunks of edited texts, with counts of lines added and removed; hunks closer than their context are one."""
    ship_code(both.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, old, new in zip(b["path"], b["old"], b["new"]):
                x, y = old.split("\n"), new.split("\n")
                for k, group in enumerate(difflib.SequenceMatcher(None, x, y, autojunk=False).get_grouped_opcodes(context)):
                    body, added, removed, first = [], 0, 0, None
                    for tag, i1, i2, j1, j2 in group:
                        if tag == "equal":
                            body += [" " + s for s in x[i1:i2]]
                            continue
                        first = j1 + 1 if first is None else first
                        body += ["-" + s for s in x[i1:i2]] + ["+" + s for s in y[j1:j2]]
                        removed, added = removed + i2 - i1, added + j2 - j1
                    i1, i2, j1, j2 = group[0][1], group[-1][2], group[0][3], group[-1][4]
                    out.append((path, k, i1 + 1, i2 - i1, j1 + 1, j2 - j1, first, added, removed, "\n".join(body)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HUNKS.split(", ")])

    return classify(both).where("change = 'edited'").select("path", "old", "new").mapInPandas(run, HUNKS)


def labelled_hunks(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hunks with the symbol around their first changed line."""
    own = innermost(hunks.withColumn("line", F.col("first_changed")), symbols, ["path", "hunk"])
    name = symbols.select("path", F.col("idx").alias("owner_idx"), F.col("qualified").alias("symbol"))
    return own.join(name, ["path", "owner_idx"], "left").drop("line", "owner_idx")


def diff_counts(hunks: DataFrame) -> DataFrame:
    """(path, hunks, added, removed, size); ``shown_whole`` says from the size which texts are shown whole."""
    return hunks.groupBy("path").agg(F.count(F.lit(1)).alias("hunks"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum(F.char_length("body") + 24).alias("size"))


def shown_whole(counts: DataFrame, after: DataFrame) -> DataFrame:
    return counts.join(after.select("path", F.char_length("content").alias("_n")), "path").withColumn("whole", F.col("size") * 10 >= F.col("_n") * WHOLE_ABOVE).drop("_n")


def numbered(symbols: DataFrame) -> DataFrame:
    """Symbols with their number among those of one qualified name in a text."""
    return symbols.withColumn("nth", F.row_number().over(W.partitionBy("path", "qualified").orderBy("idx")))


def symbol_changes(before: DataFrame, after: DataFrame, old_sources: DataFrame, new_sources: DataFrame) -> DataFrame:
    """(path, qualified, nth, change, old_signature, start): symbols added, removed, or with another signature or body.

    Of nested symbols only the innermost that changed is named: a symbol whose own lines, without those of
    its children, are the same has not changed itself.
    """

    def with_body(symbols: DataFrame, sources: DataFrame) -> DataFrame:
        lines = explode_lines(sources.where(F.col("content").isNotNull()))
        own = innermost(lines, symbols, ["path", "line"]).where("owner_idx is not null")
        digest = own.groupBy("path", F.col("owner_idx").alias("idx")).agg(F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"])), 256).alias("body"))
        return numbered(symbols).join(digest, ["path", "idx"], "left")

    return compare(with_body(before, old_sources), with_body(after, new_sources))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of symbols (path, qualified, nth, signature, body, start) from one version to the next."""
    a = before.select("path", "qualified", "nth", F.col("signature").alias("old_signature"), F.col("body").alias("old_body"), F.lit(True).alias("_was"))
    b = after.select("path", "qualified", "nth", "signature", "body", "start", F.lit(True).alias("_is"))
    met = a.join(b, ["path", "qualified", "nth"], "full_outer")
    kind = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("signature") != F.col("old_signature"), "signature").when(~F.col("body").eqNullSafe(F.col("old_body")), "body")
    rows = met.withColumn("change", kind).where("change is not null")
    return rows.select("path", "qualified", "nth", "change", F.when(F.col("change") == "signature", F.col("old_signature")).alias("old_signature"), "start")


class Snapshots:
    """Texts already shown, by etag: a table that grows by what it lacks."""

    SCHEMA = "etag string, path string, content string, n_lines int, seen_at timestamp"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def remember(self, sources: DataFrame) -> None:
        rows = sources.where(F.col("content").isNotNull()).select(etag("content").alias("etag"), "path", "content", "n_lines")
        new = rows.dropDuplicates(["etag"]).join(self.table().select("etag"), "etag", "left_anti")
        new.withColumn("seen_at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def since(self, after: DataFrame, etags: DataFrame) -> DataFrame:
        """``classify`` of texts against the versions that their etags (path, etag) name; null ``old`` if unknown."""
        old = etags.join(self.table().select("etag", F.col("content").alias("old")), "etag", "left")
        return classify(old.select("path", "old").join(after.select("path", F.col("content").alias("new")), "path"))
