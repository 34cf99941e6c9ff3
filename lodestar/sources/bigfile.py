"""Files too large for one row: numbered lines, ranges, and whether a version goes on from an earlier one.

A file is read in blocks by many tasks.  A block's lines are numbered by their order in it, and blocks by a table
with one row each that carries the counts on; the text itself is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text) of every line of a text file (or of each of several), counted from 1."""
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def between(lines: DataFrame, first: int, last: int) -> DataFrame:
    return lines.where(F.col("line").between(first, last))


def describe(lines: DataFrame) -> DataFrame:
    """(file, n_lines, bytes, digest): the digest adds up a hash of each line with its number, so that it is made in
    parts and that of a file's first lines can be told from the lines alone."""
    one = F.xxhash64("line", "text").cast("decimal(20,0)")
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("text") + 1).alias("bytes"), F.sum(one).alias("digest"))


def continues(old: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, n_lines, appended): for each file described by ``old``, whether ``lines`` begin with what it was."""
    seen = old.select("file", F.col("n_lines").alias("old_lines"), F.col("digest").alias("old_digest"))
    part = describe(lines.join(seen, "file").where(F.col("line") <= F.col("old_lines")).select("file", "line", "text"))
    met = seen.join(part, "file", "left")
    return met.select("file", F.col("old_lines").alias("n_lines"), F.coalesce((F.col("n_lines") == F.col("old_lines")) & (F.col("digest") == F.col("old_digest")), F.lit(False)).alias("appended"))
