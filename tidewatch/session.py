"""Spark sessions with the settings that the operators count on."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tidewatch", **conf: str) -> SparkSession:
    """UTC, adaptive plans, Arrow transfer; ``conf`` keys use ``__`` for dots."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.appName(name).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is unset and all threads share this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/tidewatch-{os.getuid()}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone by then
        pass


_kept: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the application's own folder in the shared folder; the folder goes when the driver ends."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _kept:
        _kept.add(own)
        atexit.register(_delete, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def file_a_task(spark: SparkSession) -> Iterator[None]:
    """Within it, plans give each small file to a task of its own instead of packing files together."""
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(cost, before)
