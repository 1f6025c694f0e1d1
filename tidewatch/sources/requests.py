"""Access requests as canonical events, and what a live request knows better than its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the action that leaves the premises whatever its resource.
EGRESS_ACTION = "execute-api:Invoke"


def to_events(requests: DataFrame) -> DataFrame:
    """event_id, ts, principal, action, resource, source, pc, egress, bytes_read of (event_id, ts, principal, action, resource, device_id, source_ip, bytes_requested)."""
    host = F.coalesce(F.nullif("device_id", F.lit("")), F.nullif("source_ip", F.lit("")), F.lit(""))
    egress = (F.col("action") == EGRESS_ACTION) | F.contains("resource", F.lit("/removable/"))
    return requests.select("event_id", "ts", "principal", "action", "resource", F.lit("pdp").alias("source"), host.alias("pc"), egress.alias("egress"), F.coalesce(F.col("bytes_requested").cast("long"), F.lit(0).cast("long")).alias("bytes_read"))


def overridden(sensitivity: Column, managed: Column, mfa_age: Column) -> dict[str, Column]:
    """The three features that the policy and the live context decide, over the columns of the history's own."""
    return {
        "resource_sensitivity": sensitivity.cast("double"),
        "device_fingerprint_match": F.when(F.coalesce(managed, F.lit(False)), 1.0).otherwise(F.col("device_fingerprint_match")),
        "log_mfa_age": F.when(mfa_age.isNotNull(), F.log1p(F.greatest(F.lit(0.0), mfa_age))).otherwise(F.col("log_mfa_age")),
    }
