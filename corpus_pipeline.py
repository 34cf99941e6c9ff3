"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir).  Its result is written as Parquet and read again as the next one's
``docs``; all but the last return the columns of ``documents``.

* quality: documents that the quality rules reject go;
* near_duplicates: of each group of linked SimHash fingerprints the document with the least id stays;
* decontaminate: documents that hold a benchmark window go;
* secrets: secrets in the texts, encoded ones too, are replaced by a mark (no document goes);
* sentencepiece: texts become piece ids.

Nulls, empty texts, repeated rows and extra columns are handled as the operators say; rows repeated with one id
count as one group for near_duplicates, and one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontam, pieces, quality, secrets, simhash
from lodestar.llm.common import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least id; of rows repeated with that id, one."""
    return simhash.survivors(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redacted(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every document."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SimHash components and SentencePiece ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
