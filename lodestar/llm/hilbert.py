"""Sharding along a Hilbert curve.  DataFrame operations only.

Metadata of each document (language, source, size, id) is quantised to ``BITS`` bits a dimension by quantiles;
the cell's index on the Hilbert curve orders the rows; the ordered rows are cut into runs of near-equal bytes.
Neighbours on the curve are neighbours in every dimension, so a shard covers a compact box of the metadata and a
predicate on any dimension skips shards by their minimum and maximum (``manifest``, ``prune``).

Law: ``bytes``.  A document's shard is that of the midpoint of its run of bytes.  Equal texts share one cell
(that of their least metadata) and stand side by side; a group of equal texts of at most 1/``WHOLE`` of a shard
goes to one shard whole, a larger one is cut like any run, so sizes stay within about 1/``WHOLE`` of equal.

The order is total and dealt out by range, so a key or group that holds a third of the rows is spread over
tasks.  Running sums are taken per range and carried on by a table with one row a range.

Defined results: null text has size 1 and checksum 0; null metadata is the least value; repeated rows and ties get slots
one by one; a very long text counts with all its bytes, and only its size and hashes are moved; an empty table gives an
empty table; extra columns are ignored, or carried along by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.llm.common import materialize, meet, pick

SHARDS = 8
BITS = 4
WHOLE = 50
DIMENSIONS = ("lang", "source", "size", "doc_id")


def _trailing_ones(i: int) -> int:
    return ((i ^ (i + 1)).bit_length()) - 1


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Hamilton's state update of the n-dimensional curve as tables, by state * 2 ** n + label.

    A state is an entry point and a direction; a label holds one bit of each coordinate.  The tables give the
    sub-cell's place on the curve and the state within it.
    """
    mask = (1 << n) - 1
    gray = lambda i: i ^ (i >> 1)
    left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    inverse = {gray(i): i for i in range(1 << n)}
    entry = [0 if i == 0 else gray(2 * ((i - 1) // 2)) for i in range(1 << n)]
    direction = [0 if i == 0 else _trailing_ones(i - 1 if i % 2 == 0 else i) % n for i in range(1 << n)]
    place, after = [], []
    for state in range(n << n):
        d, e = state >> n, state & mask
        for label in range(1 << n):
            w = inverse[left(label ^ e, n - (d + 1) % n)]
            place.append(w)
            after.append(((d + direction[w] + 1) % n) << n | (e ^ left(entry[w], (d + 1) % n)))
    return place, after


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The index on the curve of a cell with ``bits`` bits in each dimension."""
    n = len(cells)
    place, after = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(n))
    labels = []
    for level in reversed(range(bits)):
        label = F.lit(0)
        for j, c in enumerate(cells):
            label = label + F.shiftright(c.cast("int"), level).bitwiseAND(F.lit(1)) * (1 << j)
        labels.append(label)

    def step(s: Column, label: Column) -> Column:
        at = F.shiftleft(s["s"], n) + label
        return F.struct(F.get(after, at).alias("s"), (s["h"] * (1 << n) + F.get(place, at)).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*labels), start, step)["h"]


def _width(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(rows: DataFrame, order: tuple[str, ...], *sizes: str) -> DataFrame:
    """``rows`` in a total order with ``idx`` (from 0), ``upto_<size>`` (the sum up to and with a row) and ``total_<size>``.

    Rows are dealt out by range; the sums before a range come from a table with one row a range.
    """
    ranged = materialize(rows.repartitionByRange(_width(rows), *order).withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("p_rows"), *[F.sum(c).alias(f"p_{c}") for c in sizes])
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    start = lambda c, to: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(to)
    parts = parts.select("part", start("p_rows", "s_rows"), *[start(f"p_{c}", f"s_{c}") for c in sizes], *[F.sum(f"p_{c}").over(every).alias(f"total_{c}") for c in sizes])
    w = W.partitionBy("part").orderBy(*order)
    run = ranged.withColumn("idx", F.row_number().over(w)).withColumns({f"upto_{c}": F.sum(c).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) for c in sizes})
    run = run.join(F.broadcast(parts), "part")  # one row for each shuffle partition
    run = run.withColumns({"idx": F.col("s_rows") + F.col("idx") - 1} | {f"upto_{c}": F.col(f"s_{c}") + F.col(f"upto_{c}") for c in sizes})
    return run.drop("part", "s_rows", *[f"s_{c}" for c in sizes])


def _is_number(rows: DataFrame, c: str) -> bool:
    return rows.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")


def _bounds(rows: DataFrame, bits: int) -> dict[str, list]:
    """Quantiles of each dimension, at most 2 ** bits - 1 of them: a few values, kept on the driver.

    Those of strings are taken over the distinct values and their counts, whole strings in their order.
    """
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [c for c in DIMENSIONS if _is_number(rows, c)]
    got = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in numbers]).first()
    out = {c: sorted(set(got[c] or [])) for c in numbers}
    for c in DIMENSIONS:
        if c not in out:
            values = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
            ranks = lambda upto: F.floor(upto * F.lit(1 << bits) / F.col("total_n"))  # noqa: B023, E731
            crossing = ranks(F.col("upto_n")) > ranks(F.col("upto_n") - F.col("n"))
            out[c] = sorted(r.v for r in running(values, ("v",), "n").where(crossing).select("v").collect())
    return out


def _quantised(rows: DataFrame, bits: int) -> list[Column]:
    bounds = _bounds(rows, bits)
    out = []
    for c in DIMENSIONS:
        value = F.col(c) if _is_number(rows, c) else F.col(c).cast("string")
        cell = F.lit(0)
        for b in bounds[c]:
            cell = cell + F.coalesce(value > F.lit(b), F.lit(False)).cast("int")
        out.append(cell)
    return out


def plan(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source, hilbert, shard, slot, *carry) for every row of ``docs``."""
    d = pick(docs, "doc_id", "text", "lang", "source", *carry).withColumn("text", F.col("text").cast("string"))
    rows = d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("group"),
        "lang",
        "source",
        *carry,
    )
    # the number tells repeated rows apart, so that they can be dealt out
    rows = materialize(rows.withColumn("nth", F.monotonically_increasing_id()), "rows")
    # equal texts share the cell of their least metadata; groups of one row need no join
    groups = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("g_rows"), F.sum("size").alias("g_bytes"), *[F.min(c).alias(f"g_{c}") for c in ("lang", "source", "doc_id")]
    )
    many = materialize(groups.where("g_rows > 1"), "groups")
    total = rows.count()
    met = meet(rows, many, "group", "g_rows", total)
    shown = {c: F.when(F.col("g_rows").isNull(), F.col(c)).otherwise(F.col(f"g_{c}")).alias(c) for c in ("lang", "source", "doc_id")}
    cell = rows.select("size", "lang", "source", "doc_id")
    by = _quantised(cell, bits)
    placed = met.select("*", F.struct(*[shown[c] if c in shown else F.col(c) for c in DIMENSIONS]).alias("as"))
    placed = placed.select(*[c for c in placed.columns if c not in DIMENSIONS], *[F.col("as")[c].alias(c) for c in DIMENSIONS], F.struct("lang", "source", "doc_id").alias("own"))
    # the cell's coordinates are fixed before the curve reads each of them once a bit
    placed = placed.withColumn("cell", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(by)]))
    placed = placed.withColumn("hilbert", hilbert_index([F.col("cell")[f"c{i}"] for i in range(len(by))], bits))
    placed = placed.select("group", "g_rows", "g_bytes", "size", "text_crc32", "hilbert", "nth", *carry, *[F.col("own")[c].alias(c) for c in ("lang", "source", "doc_id")])
    placed = materialize(placed, "placed")  # the sort reads it twice, once for its bounds
    run = running(placed, ("hilbert", "group", "doc_id", "lang", "source", "nth"), "size")
    run = run.withColumn("start", F.col("upto_size") - F.col("size")).withColumnRenamed("total_size", "total")
    run = materialize(run.select("doc_id", "size", "text_crc32", "group", "g_rows", "g_bytes", "lang", "source", "hilbert", "start", "idx", "total", *carry), "run")
    whole = F.coalesce((F.col("g_rows") > 1) & (F.col("g_bytes") * (shards * WHOLE) <= F.col("total")), F.lit(False))
    firsts = materialize(run.where(whole).groupBy("group").agg(F.min("start").alias("g_start"), F.count(F.lit(1)).alias("n")), "firsts")
    cut = meet(run.where(whole), firsts, "group", "n", total).drop("n").unionByName(run.where(~whole).withColumn("g_start", F.lit(None).cast("long")))
    middle = F.when(F.col("g_start").isNotNull(), 2 * F.col("g_start") + F.col("g_bytes")).otherwise(2 * F.col("start") + F.col("size"))
    cut = cut.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("total")))).cast("int"))
    cut = materialize(cut, "cut")
    first = cut.groupBy("shard").agg(F.min("idx").alias("first"))
    out = cut.join(F.broadcast(first), "shard")  # one row for each shard
    return out.select("doc_id", "size", "text_crc32", "lang", "source", "hilbert", "shard", (F.col("idx") - F.col("first")).cast("long").alias("slot"), *carry)


def manifest(planned: DataFrame) -> DataFrame:
    """Rows, bytes and the range of each dimension by shard."""
    return planned.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("size").alias("bytes"),
        *[f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))],
    )


def prune(shards: DataFrame, dimension: str, low, high) -> DataFrame:
    """The shards of a manifest that can hold values of a dimension between low and high (inclusive)."""
    return shards.where((F.col(f"min_{dimension}") <= F.lit(high)) & (F.col(f"max_{dimension}") >= F.lit(low)))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write ``docs`` as one folder a shard, rows in slot order, and return the manifest."""
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    planned = materialize(plan(numbered, shards, carry=("_row",)), "plan")
    rows = numbered.join(planned.select("_row", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), "_row").drop("_row")
    # each shard is written by as many tasks as its ranges take, in files that follow each other
    rows.repartitionByRange(_width(rows), "_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)
    return manifest(planned)
