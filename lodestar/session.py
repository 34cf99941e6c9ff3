"""What every Spark job of the library needs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_code(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python, once per application."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lodestar_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "lodestar_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "lodestar").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._lodestar_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, below ``spark.checkpoint.dir``; it goes when the session ends.

    Where everything runs on one machine the setting may be empty; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", "lodestar")
    path = f"{found.rstrip('/')}/lodestar-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, its lineage cut on storage that survives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
