"""The event model over the star-schema test tables: events stand in for activity, customers for staff.

Labels are derived by rule (an error of a value over 150) and are synthetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def org(spark: SparkSession, sf_dir: str) -> DataFrame:
    """principal, role, business_unit, functional_unit, department, team, supervisor, unit_bucket."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # a table of fixed size
    c = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    key, n = F.col("c_custkey"), F.col("c_nationkey") % 6
    return c.select(
        key.cast("string").alias("principal"),
        F.when(n == 0, "ITAdmin").when(n == 1, "Director").when(n == 2, "Security Recruiter").otherwise("Salesman").alias("role"),
        F.col("r_name").alias("business_unit"),
        F.concat(F.lit("1 - "), F.col("c_mktsegment")).alias("functional_unit"),
        F.col("n_name").alias("department"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("T"), (key % 10).cast("string"))).alias("team"),
        F.when(key % 10 == 0, "").otherwise(F.concat(F.lit("S"), (key % 10).cast("string"))).alias("supervisor"),
        C.bucket(F.concat(F.lit("1 - "), F.col("c_mktsegment")), F.col("r_name")).alias("unit_bucket"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with action, source, host and the rest but for the resource."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("principal"), kind, k.alias("k"), "value")
    view = F.col("event_type") == "view"
    source = F.when(F.col("event_type").isin("signup", "error"), "logon").when(F.col("event_type") == "purchase", "device").when(F.col("event_type") == "click", "http").when(F.col("k") % 3 == 0, "file").otherwise("store")
    action = F.when(F.col("event_type") == "signup", "sts:AssumeRole").when(F.col("event_type") == "error", "sts:SessionEnd").when(F.col("event_type") == "click", "execute-api:Invoke").when(view & (F.col("k") % 3 == 2), "s3:PutObject").otherwise("s3:GetObject")
    return e.select(
        "event_id", "ts", "principal", "k", action.alias("action"), source.alias("source"),
        F.when(F.col("k") % 7 == 6, "").otherwise(F.concat(F.lit("PC-"), (F.col("k") % 7).cast("string"))).alias("pc"),
        F.floor(F.abs("value")).cast("long").alias("bytes_read"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 150), 1).otherwise(0).alias("label"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with the organisation's columns beside them (left join, known or not)."""
    e = raw_events(spark, sf_dir).join(org(spark, sf_dir).withColumn("known", F.lit(True)), "principal", "left")
    place = F.when(F.col("k") % 10 == 7, "org-shared").otherwise(F.coalesce("unit_bucket", F.lit("org-unassigned")))
    k = F.col("k").cast("string")
    resource = (
        F.when(F.col("source") == "logon", F.concat(F.lit("arn:aws:iam::000000000000:role/"), place, F.lit("-session")))
        .when(F.col("source") == "http", F.concat(F.lit("arn:aws:execute-api:::site-"), (F.col("k") % 20).cast("string")))
        .when(F.col("source") == "device", F.concat(F.lit("arn:aws:s3:::"), place, F.lit("/removable/"), F.col("pc")))
        .when(F.col("source") == "file", F.concat(F.lit("arn:aws:s3:::"), place, F.lit("/removable/f"), k))
        .otherwise(F.concat(F.lit("arn:aws:s3:::"), place, F.lit("/docs/"), k))
    )
    return e.withColumn("resource", resource).withColumn("egress", F.col("source").isin("device", "file", "http")).withColumn("known", F.coalesce("known", F.lit(False)))
