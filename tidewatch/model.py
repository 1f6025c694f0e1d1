"""Schemas and fixed values of the event model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

# Column orders of the activity files and the organisation snapshots.
HEADERS: dict[str, tuple[str, ...]] = {
    "logon": ("id", "date", "user", "pc", "activity"),
    "device": ("id", "date", "user", "pc", "activity"),
    "file": ("id", "date", "user", "pc", "filename", "content"),
    "http": ("id", "date", "user", "pc", "url", "content"),
    "email": ("id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content"),
}
ORG_HEADER = ("employee_name", "user_id", "email", "role", "business_unit", "functional_unit", "department", "team", "supervisor")
TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"

EVENT = T.StructType([
    T.StructField("event_id", S), T.StructField("ts", T.TimestampNTZType()), T.StructField("principal", S), T.StructField("action", S), T.StructField("resource", S), T.StructField("source", S),
    T.StructField("pc", S), T.StructField("egress", B), T.StructField("bytes_read", L), T.StructField("label", T.ByteType()), T.StructField("extra", T.MapType(S, S)),
])

# The 34 features in their order.
FEATURES: tuple[str, ...] = (
    "principal_type", "role_tenure_days", "policy_breadth", "cross_account_depth", "is_supervisor",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "modal_hour_deviation", "log_inter_request_gap",
    "action_frequency", "read_write_ratio", "first_time_action", "action_class_entropy", "log_action_history", "is_session_action", "is_egress_action",
    "resource_sensitivity", "cross_account_flag", "resource_novelty", "arn_prefix_depth", "first_time_resource",
    "calls_1min", "calls_15min", "calls_60min", "log_bytes_read_60min", "distinct_resources_60min", "distinct_actions_60min",
    "asn_novelty", "geodesic_distance_km", "device_fingerprint_match", "log_mfa_age", "host_novelty",
)
CONTINUOUS = (
    "role_tenure_days", "policy_breadth", "cross_account_depth", "log_inter_request_gap", "log_action_history", "arn_prefix_depth", "calls_1min", "calls_15min",
    "calls_60min", "log_bytes_read_60min", "distinct_resources_60min", "distinct_actions_60min", "geodesic_distance_km", "log_mfa_age",
)
VOLUME = ("calls_1min", "calls_15min", "calls_60min", "log_bytes_read_60min", "distinct_resources_60min", "distinct_actions_60min")
DAY_FLAGS = ("is_egress_action", "is_session_action", "first_time_action", "first_time_resource", "host_novelty")

# Actions, sensitivities, decay, trust and calibration constants.
ACTIONS = ("sts:AssumeRole", "sts:SessionEnd", "s3:GetObject", "s3:PutObject", "execute-api:Invoke")
READS = ("s3:GetObject", "execute-api:Invoke", "sts:AssumeRole")
SESSIONS = ("sts:AssumeRole", "sts:SessionEnd")
SENSITIVITY = {"removable": 1.0, "external": 0.8, "session": 0.3, "bucket": 0.6, "default": 0.5}
HALF_LIFE_DAYS = 30.0
EARTH_KM = 6371.0
MFA_WINDOW_S = 28800.0
LAMBDA, BETA, ALPHA = 1.5, 0.25, 0.6
CDF_LEAST_ROWS = 200
DENY = 0.85


@dataclass(frozen=True)
class Band:
    lower: float
    verdict: str
    ttl_minutes: int | None
    scope: str


# The bands.
BANDS = (Band(0.0, "ALLOW", 60, "as_requested"), Band(0.40, "ALLOW_OBSERVE", 30, "as_requested_verbose"), Band(0.65, "STEPUP", 15, "read_only"), Band(DENY, "DENY", None, "none"))

#: The decision record; ``r`` and ``r_eff`` are named r and R in its canonical bytes only.
RECORD = T.StructType([
    T.StructField("recId", S), T.StructField("prevHash", S), T.StructField("seq", L), T.StructField("ts", S), T.StructField("principal", S), T.StructField("action", S), T.StructField("resource", S),
    T.StructField("r", D), T.StructField("r_eff", D), T.StructField("verdict", S), T.StructField("h_feat", S), T.StructField("sig", S),
])
GENESIS = "0" * 64
