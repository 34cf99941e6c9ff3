"""Running numbers and sums over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.session import materialize


def running(rows: DataFrame, order: list[str], *sizes: str, number: str = "nth") -> DataFrame:
    """``rows`` with their number in the order, from 1, and for each of ``sizes`` the sum up to and with a row as ``upto_<size>``.

    Rows are dealt out by range of ``order``, which should be total; what stands before a range is a table of one row a
    range.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id()), "running")
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_{c}") for c in sizes])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in ("rows", *sizes)])
    by = W.partitionBy("_part").orderBy(*order)
    own = dealt.withColumns({number: F.row_number().over(by)} | {f"upto_{c}": F.sum(c).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)) for c in sizes})
    out = own.join(F.broadcast(starts), "_part").withColumns({number: F.col(number) + F.col("_s_rows")} | {f"upto_{c}": F.col(f"upto_{c}") + F.col(f"_s_{c}") for c in sizes})
    return out.drop("_part", "_s_rows", *[f"_s_{c}" for c in sizes])
