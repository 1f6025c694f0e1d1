"""The corpus pipeline: toxic documents go, repeated lines go, near copies go, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the
last return the columns of ``documents`` (``n_chars`` follows the text where a stage changes it).
``run`` writes each stage's result to the shared folder and reads it back.

Defined results, in every stage: a null text counts as an empty one and stays null; rows with a null doc_id are kept and
link with nothing; rows that repeat a doc_id go or stay together in the near-copy stage, and are rows of their own in the
others; texts are taken whole, however long; of equal lines and near copies the one of the least doc_id (then place) stays;
further columns, whatever their names, come through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import linededup, neardup, packing, secrets, toxicity
from tidewatch.llm.common import materialise, table

#: Similarity of five-word sets from which documents are near copies, in percent.
NEAR_PERCENT = 80
#: Characters from which lines match within one edit, whatever their words.
NEAR_CHARS = 20


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more are rejected."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line stands for are cut; every document stays."""
    return _recounted(linededup.dedup(docs, near_chars=NEAR_CHARS))


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id."""
    gone = neardup.groups(docs, percent=NEAR_PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by a mark; every document stays."""
    return _recounted(secrets.redact(docs))


def documents_are_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", repeated_lines_go),
    ("near_dedup", near_copies_go),
    ("secret_scans", secrets_are_masked),
    ("packing", documents_are_packed),
]

#: Classifier and tokenizer have no SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
