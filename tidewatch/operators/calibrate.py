"""Empirical distribution functions: global, by type with a fallback, and fused scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import model as M
from tidewatch.operators.running import running


def ecdf(calibration: DataFrame, queries: DataFrame, value: str, by: tuple[str, ...] = (), out: str = "f") -> DataFrame:
    """``queries`` with the share of calibration values at or below theirs, in each group of ``by``.

    Both sides meet as counts at distinct values, so that frequent values cost one row; the running
    count goes over those rows, bucket by bucket, with or without groups.
    """
    keys = list(by)
    marks = calibration.groupBy(*keys, value).agg(F.count("*").alias("_n")).unionByName(queries.select(*keys, value).distinct().withColumn("_n", F.lit(0).cast("long")))
    marks = marks.groupBy(*keys, value).agg(F.sum("_n").alias("_n"))
    sizes = calibration.groupBy(*keys).agg(F.count("*").alias("_rows"))  # one row a group
    whole = running(marks, value, {"_below": "_n"}, tuple(keys))
    table = whole.join(sizes, keys, "left") if keys else whole.join(F.broadcast(sizes))  # a single row
    table = table.select(*keys, value, F.try_divide(F.col("_below").cast("double"), F.col("_rows").cast("double")).alias(out), F.coalesce("_rows", F.lit(0)).alias("_rows"))
    return queries.join(table, [*keys, value], "left")


def ecdf_with_fallback(calibration: DataFrame, queries: DataFrame, value: str, kind: str, least: int = M.CDF_LEAST_ROWS) -> DataFrame:
    """By ``kind`` where it has ``least`` calibration rows, else global; adds f."""
    typed = ecdf(calibration, queries, value, (kind,), "_f").withColumnRenamed("_rows", "_own")
    both = ecdf(calibration, typed, value, (), "_g").drop("_rows")
    return both.withColumn("f", F.when(F.col("_own") >= least, F.col("_f")).otherwise(F.col("_g"))).drop("_f", "_g", "_own")
