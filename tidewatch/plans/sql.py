"""DuckDB SQL pieces that the queries' oracles share: the event model and the 34 features."""

from __future__ import annotations

ORG = """org AS (SELECT CAST(c_custkey AS VARCHAR) AS principal,
  CASE c_nationkey % 6 WHEN 0 THEN 'ITAdmin' WHEN 1 THEN 'Director' WHEN 2 THEN 'Security Recruiter' ELSE 'Salesman' END AS role,
  r_name AS business_unit, '1 - ' || c_mktsegment AS functional_unit, n_name AS department,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'T' || (c_custkey % 10) END AS team,
  CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'S' || (c_custkey % 10) END AS supervisor,
  'org-' || trim(regexp_replace(lower(trim('1 - ' || c_mktsegment)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS unit_bucket
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

EV = (
    ORG
    + """,
raw AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS principal, event_type, CAST(props->>'$.k' AS INTEGER) AS k, value FROM events),
ev0 AS (SELECT event_id, ts, principal, k,
  CASE WHEN event_type = 'signup' THEN 'sts:AssumeRole' WHEN event_type = 'error' THEN 'sts:SessionEnd' WHEN event_type = 'click' THEN 'execute-api:Invoke' WHEN event_type = 'view' AND k % 3 = 2 THEN 's3:PutObject' ELSE 's3:GetObject' END AS action,
  CASE WHEN event_type IN ('signup', 'error') THEN 'logon' WHEN event_type = 'purchase' THEN 'device' WHEN event_type = 'click' THEN 'http' WHEN k % 3 = 0 THEN 'file' ELSE 'store' END AS source,
  CASE WHEN k % 7 = 6 THEN '' ELSE 'PC-' || (k % 7) END AS pc, CAST(floor(abs(value)) AS BIGINT) AS bytes_read,
  CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END AS label FROM raw),
ev1 AS (SELECT e.*, o.role, o.business_unit, o.functional_unit, o.department, o.team, o.supervisor, o.unit_bucket, o.principal IS NOT NULL AS known,
  CASE WHEN k % 10 = 7 THEN 'org-shared' ELSE coalesce(o.unit_bucket, 'org-unassigned') END AS place FROM ev0 e LEFT JOIN org o USING (principal)),
ev AS (SELECT *, source IN ('device', 'file', 'http') AS egress,
  CASE WHEN source = 'logon' THEN 'arn:aws:iam::000000000000:role/' || place || '-session' WHEN source = 'http' THEN 'arn:aws:execute-api:::site-' || (k % 20)
    WHEN source = 'device' THEN 'arn:aws:s3:::' || place || '/removable/' || pc WHEN source = 'file' THEN 'arn:aws:s3:::' || place || '/removable/f' || k ELSE 'arn:aws:s3:::' || place || '/docs/' || k END AS resource FROM ev1)"""
)

_READS = "('s3:GetObject', 'execute-api:Invoke', 'sts:AssumeRole')"
_PARTS = ["sts:AssumeRole", "sts:SessionEnd", "s3:GetObject", "s3:PutObject", "execute-api:Invoke"]
SENSITIVITY = "CASE WHEN egress AND contains(resource, 'removable') THEN 1.0 WHEN action = 'execute-api:Invoke' THEN 0.8 WHEN action IN ('sts:AssumeRole', 'sts:SessionEnd') THEN 0.3 WHEN starts_with(resource, 'arn:aws:s3:::') THEN 0.6 ELSE 0.5 END::DOUBLE"

FEAT = (
    EV
    + """,
h0 AS (SELECT *, epoch_us(ts) AS us, sha256(pc) AS hx FROM ev),
h1 AS (SELECT *, pow(2.0, (us - min(us) OVER (PARTITION BY principal)) / (30.0 * 86400e6)) AS w,
  CASE WHEN pc = '' THEN 'AS0' ELSE 'AS' || ('0x' || substr(hx, 1, 4))::BIGINT END AS asn,
  CASE WHEN pc = '' THEN 0.0 ELSE ('0x' || substr(hx, 5, 6))::BIGINT / 16777215.0::DOUBLE * 180 - 90 END AS lat,
  CASE WHEN pc = '' THEN 0.0 ELSE ('0x' || substr(hx, 11, 6))::BIGINT / 16777215.0::DOUBLE * 360 - 180 END AS lon FROM h0),
h2 AS (SELECT *, row_number() OVER o AS rn, coalesce(sum(w) OVER pr, 0) AS total, coalesce(sum(CASE WHEN action IN """
    + _READS
    + """ THEN w ELSE 0 END) OVER pr, 0) AS reads,
  ["""
    + ", ".join(f"coalesce(sum(CASE WHEN hour(ts) = {h} THEN w ELSE 0 END) OVER pr, 0)" for h in range(24))
    + """] AS hours,
  ["""
    + ", ".join(f"coalesce(sum(CASE WHEN action = '{a}' THEN w ELSE 0 END) OVER pr, 0)" for a in _PARTS)
    + """] AS parts,
  lag(us) OVER o AS prev_us, min(us) OVER pr AS first_us, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon,
  max(CASE WHEN action = 'sts:AssumeRole' THEN us END) OVER pr AS logon_us,
  list({'rn': event_id, 'us': us, 'resource': resource, 'action': action, 'b': bytes_read}) OVER (PARTITION BY principal ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent_,
  CASE WHEN row_number() OVER (PARTITION BY principal, action ORDER BY us, event_id) = 1 THEN 1.0 ELSE 0.0 END AS fta,
  CASE WHEN row_number() OVER (PARTITION BY principal, resource ORDER BY us, event_id) = 1 THEN 1.0 ELSE 0.0 END AS ftr,
  coalesce(sum(w) OVER (PARTITION BY principal, action ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS asum,
  coalesce(sum(w) OVER (PARTITION BY principal, resource ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rsum,
  CASE WHEN row_number() OVER (PARTITION BY principal, asn ORDER BY us, event_id) = 1 THEN 1.0 ELSE 0.0 END AS nasn,
  CASE WHEN pc = '' OR row_number() OVER (PARTITION BY principal, pc ORDER BY us, event_id) = 1 THEN 1.0 ELSE 0.0 END AS npc
  FROM h1 WINDOW o AS (PARTITION BY principal ORDER BY us, event_id), pr AS (PARTITION BY principal ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h3 AS (SELECT *, list_filter(recent_, lambda x: x.us < us OR (x.us = us AND x.rn < event_id)) AS recent FROM h2),
feat AS (SELECT event_id, ts, principal, source, action, resource, label,
  CAST(regexp_matches(lower(coalesce(role, '')), 'admin|director|(^|[^a-z])it([^a-z]|$)') AS DOUBLE) AS principal_type,
  coalesce((us - first_us) / 86400e6, 0) AS role_tenure_days,
  coalesce(sum(fta) OVER (PARTITION BY principal ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS policy_breadth,
  CAST((coalesce(business_unit, '') <> '')::INT + (coalesce(functional_unit, '') <> '')::INT + (coalesce(department, '') <> '')::INT + (coalesce(team, '') <> '')::INT AS DOUBLE) AS cross_account_depth,
  CAST(known AND trim(coalesce(supervisor, '')) = '' AS DOUBLE) AS is_supervisor,
  sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0) AS hour_sin, cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24.0) AS hour_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7.0) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7.0) AS dow_cos,
  CASE WHEN total > 0 THEN least(abs(hour(ts) - (list_position(hours, list_max(hours)) - 1)), 24 - abs(hour(ts) - (list_position(hours, list_max(hours)) - 1))) / 12.0 ELSE 0 END::DOUBLE AS modal_hour_deviation,
  coalesce(ln(1 + greatest(0, (us - prev_us) / 1e6)), 0) AS log_inter_request_gap,
  CASE WHEN total > 0 THEN asum / total ELSE 0 END AS action_frequency, CASE WHEN total > 0 THEN reads / total ELSE 0.5 END AS read_write_ratio, fta::DOUBLE AS first_time_action,
  CASE WHEN total > 0 THEN -list_sum(list_transform(parts, lambda p: CASE WHEN p > 0 THEN p / total * ln(p / total) ELSE 0 END)) ELSE 0 END AS action_class_entropy,
  ln(1 + total / w) AS log_action_history, CAST(action IN ('sts:AssumeRole', 'sts:SessionEnd') AS DOUBLE) AS is_session_action, CAST(egress AS DOUBLE) AS is_egress_action, """
    + SENSITIVITY
    + """ AS resource_sensitivity,
  CAST(known AND starts_with(resource, 'arn:aws:s3:::') AND split_part(split_part(resource, ':::', 2), '/', 1) <> unit_bucket AS DOUBLE) AS cross_account_flag,
  1 - CASE WHEN total > 0 THEN rsum / total ELSE 0 END AS resource_novelty, CAST(length(resource) - length(replace(resource, '/', '')) AS DOUBLE) AS arn_prefix_depth, ftr::DOUBLE AS first_time_resource,
  len(list_filter(recent, lambda x: us - x.us <= 60000000))::DOUBLE AS calls_1min, len(list_filter(recent, lambda x: us - x.us <= 900000000))::DOUBLE AS calls_15min, len(recent)::DOUBLE AS calls_60min,
  ln(1 + coalesce(list_sum(list_transform(recent, lambda x: x.b)), 0)::DOUBLE) AS log_bytes_read_60min,
  len(list_distinct(list_transform(recent, lambda x: x.resource)))::DOUBLE AS distinct_resources_60min, len(list_distinct(list_transform(recent, lambda x: x.action)))::DOUBLE AS distinct_actions_60min,
  nasn::DOUBLE AS asn_novelty,
  (CASE WHEN plat IS NULL THEN 0 ELSE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2)))) END)::DOUBLE AS geodesic_distance_km,
  1 - npc::DOUBLE AS device_fingerprint_match, coalesce(ln(1 + (us - logon_us) / 1e6), 0) AS log_mfa_age, npc::DOUBLE AS host_novelty FROM h3)"""
)


def rounded(columns, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0::DOUBLE AS {c}" for c in columns)  # + 0: no negative zeros
