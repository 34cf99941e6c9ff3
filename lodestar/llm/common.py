"""Helpers shared by the operators: shared-folder tables, code shipping, safe column access, word blocks."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import session

ASCII_SPACE = b" \t\n\x0b\x0c\r"
FOLD_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of our own is set only where the setting is empty and everything runs on one machine, that is in tests;
    on a cluster an empty setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", "lodestar")
        os.makedirs(found, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: an executor lost later costs the work since this table, not the work before it,
    and a table that is used twice is computed once.  Spark's file statistics then let the planner choose
    join strategies by the real size.  The folder is removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Largest table, in bytes as written and as counted rows of ``ROW_BYTES``, that is sent to every executor.
BROADCAST_BYTES = 8 << 20
#: What a row weighs in memory beside its values.
ROW_BYTES = 16


def written_bytes(df: DataFrame) -> int:
    """The size of a written table's rows in memory: its columns' widths, and the lengths of its strings, by a count over
    the table itself."""
    wide = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        wide = wide + (F.coalesce(F.octet_length(c), F.lit(0)) + 8 if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) if kind in ("array", "map", "struct") else F.lit(8))
    return df.agg(F.coalesce(F.sum(wide.cast("long")), F.lit(0)).alias("n")).first()["n"]


def checked(df: DataFrame) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its measured rows are small enough; without one else."""
    return F.broadcast(df) if written_bytes(df) <= BROADCAST_BYTES else df


#: A key is hot if it has more than this share of all rows; there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 1000


def meet(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined (``left`` or ``inner``) with ``table``, a written table with a key's number of ``rows`` in ``count``.

    A small table goes to every executor.  Of a larger one the hot keys do, which are few by their definition, and
    only the rows of other keys are shuffled.
    """
    if written_bytes(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    is_hot = F.col(count) > total * HOT_SHARE
    names = F.broadcast(table.where(is_hot).select(key).distinct())
    cold = rows.join(names, key, "left_anti").join(table.where(~is_hot), key, how)
    return rows.join(checked(table.where(is_hot)), key).unionByName(cold)


#: Most bytes in a batch that goes to Python.  The default, 64 MB, is held several times over by each task.
BATCH_BYTES = 2 << 20


def ship_code(spark: SparkSession) -> None:
    """Make ready for Python on the executors: batches of at most ``BATCH_BYTES`` (a longer text is a batch of its own),
    and this package importable, once per application."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    session.ship_code(spark)


def give_back() -> None:
    """Give free memory back, where the C library can: a Python worker outlives its task and stands beside the next one's."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact name, whatever else the table holds (``TEXT`` beside ``text``, say)."""
    where = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{where[n]}").alias(n) for n in names])


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``df`` with columns renamed to ``_c0``, ``_c1``, ...; the new name by the old one; the old names in order."""
    names = list(df.columns)
    where = {n: f"_c{i}" for i, n in reversed(list(enumerate(names)))}
    return df.toDF(*[f"_c{i}" for i in range(len(names))]), where, names


def fold_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is the same and faster where a text is all ASCII."""
    slow = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(slow)


def word_blocks(raw: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of ``raw`` (runs of bytes other than ASCII white space) in lists that cover ``size`` bytes each,
    so that a very long text never stands in memory as one list of words."""
    if len(raw) <= size:
        yield raw.split()
        return
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end : end + 1] not in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"):
            end += 1
        yield raw[at:end].split()
        at = end
