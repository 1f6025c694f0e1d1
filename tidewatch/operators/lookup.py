"""A ledger laid out for look-ups: by principal in order of its chain, and by resource.

Records lie in buckets of principals, a folder each, in order of (principal, seq) within a file; a long chain goes over
several files, cut by seq, so that no task writes a whole hot chain. Beside them stands which buckets a resource
occurs in, itself in buckets of resources. A look-up reads one bucket, or the buckets that the resource occurs in,
and in these only the row groups whose statistics or Bloom filters may hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of each kind; records of one chain that one task writes.
BUCKETS, CHAIN_ROWS = 64, 1_000_000


def bucket(of: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")


def lay_out(records: DataFrame, path: str, buckets: int = BUCKETS, chain_rows: int = CHAIN_ROWS) -> None:
    """Write ``records`` (principal, seq, resource and more) to ``path``; a null principal or resource has a bucket as well.

    Records are shuffled once; the resources once more, as distinct pairs of resource and bucket.
    """
    own = records.withColumn("_bucket", bucket(F.col("principal"), buckets))
    parts = own.repartition("_bucket", F.floor(F.col("seq") / chain_rows)).sortWithinPartitions("_bucket", "principal", "seq")
    how = {"parquet.bloom.filter.enabled#resource": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    parts.write.mode("overwrite").partitionBy("_bucket").options(**how).parquet(f"{path}/records")
    pairs = records.sparkSession.read.parquet(f"{path}/records").select("resource", F.col("_bucket").alias("found_in")).distinct()
    pairs = pairs.withColumn("_bucket", bucket(F.col("resource"), buckets))
    # A resource has one row a bucket at most, so its rows are few however many records it has.
    pairs.repartition("_bucket").sortWithinPartitions("_bucket", "resource").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/resources")


def by_principal(spark: SparkSession, path: str, principal: str, buckets: int = BUCKETS) -> DataFrame:
    """The records of one chain, in order of seq."""
    found = spark.read.parquet(f"{path}/records").where((F.col("_bucket") == bucket(F.lit(principal), buckets)) & (F.col("principal") == principal))
    return found.drop("_bucket").orderBy("seq")


def by_resource(spark: SparkSession, path: str, resource: str, buckets: int = BUCKETS) -> DataFrame:
    """All records on one resource."""
    where = spark.read.parquet(f"{path}/resources").where((F.col("_bucket") == bucket(F.lit(resource), buckets)) & (F.col("resource") == resource))
    some = [r["found_in"] for r in where.select("found_in").collect()]  # at most ``buckets`` numbers
    return spark.read.parquet(f"{path}/records").where(F.col("_bucket").isin(some) & (F.col("resource") == resource)).drop("_bucket")
