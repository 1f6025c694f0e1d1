"""A bounded sample of labelled documents, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import crc_bucket

#: Labelled rows of each class that a classifier is fitted on, at most (about).
SAMPLE_ROWS = 8_000
SAMPLE_FILES = 8


def sample(docs: DataFrame, labels: DataFrame, label: str, *, modulus: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label 0/1, weight) of training rows, about ``rows`` of each class at most.

    Rows whose crc32 bucket is ``held_out`` are left out. A class with more rows is thinned by a
    hash of the id; ``weight`` is the number of labelled rows that a row stands for. The chosen
    ids are broadcast: their number is bounded by ``rows``.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and _id is not null")
    own = own.where(crc_bucket("_id", modulus) != held_out)
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}  # two rows
    keep = F.lit(False)
    weight = F.lit(1.0)
    for value, n in counts.items():
        share = min(1.0, rows / n)
        keep = keep | ((F.col("label") == value) & (F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
        weight = F.when(F.col("label") == value, F.lit(1 / share)).otherwise(weight)
    chosen = own.where(keep).groupBy("_id").agg(F.max("label").alias("label")).withColumn("weight", weight)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample is bounded: a few files hold it, not one for each split of the whole table
    return text.join(F.broadcast(chosen), text["doc_id"] == chosen["_id"]).select("doc_id", "text", "label", "weight").repartition(SAMPLE_FILES)
