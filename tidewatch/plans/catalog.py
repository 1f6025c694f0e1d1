"""The named queries of the event model, each with DuckDB SQL where it can be expressed.

A query takes (spark, sf_dir). Scores are stand-ins: deterministic functions of the features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch import model as M
from tidewatch.functions import columns as C
from tidewatch.operators import calibrate, history, metrics, policy, rollup
from tidewatch.operators.running import quantiles
from tidewatch.plans.sql import EV, FEAT, ORG, SENSITIVITY, rounded
from tidewatch.session import scratch
from tidewatch.sources import proxy, requests, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: 30 days of events, cut 10 : 2 : 5.
START, SPANS = "2024-01-01 00:00:00", (30 * 10 / 17, 30 * 2 / 17)


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return keep


def rnd(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- sources and projections ---------------------------------------------------------------


@query(f"WITH {EV} SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, principal, action, resource, source, pc, egress, bytes_read, label FROM ev")
def event_model_projection(spark, d):
    e = proxy.events(spark, d)
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "principal", "action", "resource", "source", "pc", "egress", "bytes_read", "label")


@query(f"WITH {EV} SELECT CASE WHEN starts_with(action, 'sts:') THEN 'sts' WHEN action IN ('s3:GetObject', 's3:PutObject') AND (source IN ('device', 'file') OR contains(resource, '/removable/')) THEN 'egress' WHEN action = 's3:PutObject' THEN 's3_write' WHEN action = 's3:GetObject' THEN 's3_read' ELSE 'http' END AS kind, count(*) AS n FROM ev GROUP BY 1")
def event_type_classify(spark, d):
    return proxy.events(spark, d).groupBy(C.event_type(F.col("action"), F.col("source"), F.col("resource")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT event_id, {SENSITIVITY} AS sensitivity FROM ev")
def resource_sensitivity(spark, d):
    return proxy.events(spark, d).select("event_id", C.sensitivity(F.col("action"), F.col("resource"), F.col("egress")).cast("double").alias("sensitivity"))


@query("WITH p AS (SELECT DISTINCT c_name AS pc, sha256(c_name) AS h FROM customer) SELECT pc, 'AS' || ('0x' || substr(h, 1, 4))::BIGINT AS asn, round(('0x' || substr(h, 5, 6))::BIGINT / 16777215.0::DOUBLE * 180 - 90, 6) AS lat, round(('0x' || substr(h, 11, 6))::BIGINT / 16777215.0::DOUBLE * 360 - 180, 6) AS lon FROM p")
def host_identity(spark, d):
    h = C.host(F.col("pc"))
    return rnd(proxy.table(spark, d, "customer").select(F.col("c_name").alias("pc")).distinct().select("pc", *[c.alias(n) for n, c in h.items()]), "lat", "lon")


@query("SELECT c_mktsegment AS unit, 'org-' || trim(regexp_replace(lower(trim('1 - ' || c_mktsegment || ' & Co.')), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS bucket, count(*) AS n FROM customer GROUP BY 1, 2")
def slug_bucket(spark, d):
    unit = F.concat(F.lit("1 - "), F.col("c_mktsegment"), F.lit(" & Co."))
    return proxy.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("unit"), C.bucket(unit, F.lit("")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT event_id, source, row_number() OVER (PARTITION BY principal ORDER BY ts, event_id) AS place FROM ev WHERE source IN ('logon', 'device', 'file', 'http')")
def source_union_ordered(spark, d):
    e = proxy.events(spark, d)
    parts = [e.where(F.col("source") == s) for s in ("logon", "device", "file", "http")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return u.select("event_id", "source", F.row_number().over(Window.partitionBy("principal").orderBy("ts", "event_id")).cast("long").alias("place"))


@query(f"WITH {EV} SELECT event_id, source, row_number() OVER (ORDER BY ts, event_id) AS place FROM ev WHERE source IN ('logon', 'device', 'file', 'http')")
def source_merge_places(spark, d):
    """The four sources merged into one order and read back, each event with its place."""
    e, path = proxy.events(spark, d), scratch(spark, "merged")
    parts = [e.where(F.col("source") == s).select("ts", "event_id", "source") for s in ("logon", "device", "file", "http")]
    sinks.write_ordered(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), path)
    return sinks.read_placed(spark, path).select("event_id", "source", "place")


_SPLIT = f"CASE WHEN epoch_us(ts) < epoch_us(TIMESTAMP '{START}') + {int(SPANS[0] * 86400e6)} THEN 'train' WHEN epoch_us(ts) < epoch_us(TIMESTAMP '{START}') + {int((SPANS[0] + SPANS[1]) * 86400e6)} THEN 'val' ELSE 'test' END"


@query(f"WITH {EV}, s AS (SELECT {_SPLIT} AS split, * FROM ev) SELECT CASE WHEN split = 'train' AND label = 1 THEN 'train_malicious' ELSE split END AS split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(100.0 * sum(label) / count(*), 4) AS rate, count(DISTINCT principal) AS principals, min(event_id) AS first_id FROM s GROUP BY 1")
def time_split_counts(spark, d):
    s = rollup.routed(rollup.time_split(F.col("ts"), START, SPANS), F.col("label"))
    return proxy.events(spark, d).groupBy(s.alias("split")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.round(100.0 * F.sum("label") / F.count("*"), 4).alias("rate"), F.countDistinct("principal").alias("principals"), F.min("event_id").alias("first_id"))


_KEYS = "SELECT DISTINCT source, event_id FROM ev WHERE label = 1 OR event_id % 97 = 0"


def _labels(e: DataFrame) -> DataFrame:
    return e.where("label = 1 or event_id % 97 = 0").select("source", "event_id").distinct()


@query(f"WITH {EV}, k AS ({_KEYS}) SELECT ev.event_id, CASE WHEN k.event_id IS NULL THEN 0 ELSE 1 END AS flag FROM ev LEFT JOIN k ON ev.source = k.source AND ev.event_id = k.event_id")
def label_flag_join(spark, d):
    e = proxy.events(spark, d)
    return e.select("source", "event_id").join(_labels(e).withColumn("flag", F.lit(1)), ["source", "event_id"], "left").select("event_id", F.coalesce("flag", F.lit(0)).alias("flag"))


@query(f"WITH {EV}, k AS ({_KEYS}) SELECT ev.event_id, ev.principal FROM ev SEMI JOIN k ON ev.source = k.source AND ev.event_id = k.event_id")
def positive_semi_join(spark, d):
    e = proxy.events(spark, d)
    return e.join(_labels(e), ["source", "event_id"], "left_semi").select("event_id", "principal")


@query(f"WITH {EV}, k AS ({_KEYS}) SELECT ev.event_id, ev.principal FROM ev ANTI JOIN k ON ev.source = k.source AND ev.event_id = k.event_id")
def benign_anti_join(spark, d):
    e = proxy.events(spark, d)
    return e.join(_labels(e), ["source", "event_id"], "left_anti").select("event_id", "principal")


@query(f"WITH {EV} SELECT event_id, principal, role, business_unit, unit_bucket, known FROM ev")
def org_enrich_join(spark, d):
    return proxy.events(spark, d).select("event_id", "principal", "role", "business_unit", "unit_bucket", "known")


@query(f"WITH {ORG}, s AS (SELECT principal, 1 AS month, role FROM org UNION ALL SELECT principal, 2, role || '-2' FROM org WHERE CAST(principal AS INT) % 3 = 0) SELECT principal, max(month) AS last_month, arg_max(role, month) AS role FROM s GROUP BY 1")
def org_last_snapshot(spark, d):
    o = proxy.org(spark, d).select("principal", "role")
    s = o.withColumn("month", F.lit(1)).unionByName(o.where(F.col("principal").cast("int") % 3 == 0).select("principal", F.concat("role", F.lit("-2")).alias("role"), F.lit(2).alias("month")))
    return s.groupBy("principal").agg(F.max("month").alias("last_month"), F.max_by("role", "month").alias("role"))


@query(f"WITH {EV}, a AS (SELECT DISTINCT event_id FROM ev WHERE label = 1), b AS (SELECT DISTINCT event_id FROM ev WHERE event_id % 5 = 0), u AS (SELECT event_id FROM a UNION SELECT event_id FROM b), m AS (SELECT event_id FROM b EXCEPT SELECT event_id FROM a) SELECT (SELECT count(*) FROM u) AS union_n, (SELECT count(*) FROM m) AS new_n")
def label_set_operations(spark, d):
    e = proxy.events(spark, d)
    a, b = e.where("label = 1").select("event_id"), e.where("event_id % 5 = 0").select("event_id")
    return a.union(b).distinct().agg(F.count("*").alias("union_n")).join(b.subtract(a).agg(F.count("*").alias("new_n")))  # two single rows


@query(f"WITH {EV} SELECT source, action, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(100.0 * sum(label) / count(*), 4) AS rate FROM ev GROUP BY 1, 2")
def counts_by_source_action(spark, d):
    return proxy.events(spark, d).groupBy("source", "action").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.round(100.0 * F.sum("label") / F.count("*"), 4).alias("rate"))


@query(f"WITH {EV} SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM ev ORDER BY ts DESC, event_id DESC LIMIT 12")
def last_rows_newest_first(spark, d):
    return proxy.events(spark, d).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(12).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT event_id, value FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('click', 'view')")
def pruned_pushed_scan(spark, d):
    t = proxy.table(spark, d, "events")
    return t.where((F.col("user_id") == 3) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & F.col("event_type").isin("click", "view")).select("event_id", "value")


# --- history features ----------------------------------------------------------------------

_FAMILIES = {
    "hist_tenure_gap": ("role_tenure_days", "log_inter_request_gap"),
    "hist_first_time_flags": ("first_time_action", "first_time_resource"),
    "hist_policy_breadth": ("policy_breadth",),
    "hist_action_frequency": ("action_frequency",),
    "hist_resource_novelty": ("resource_novelty",),
    "hist_rw_ratio": ("read_write_ratio",),
    "hist_entropy": ("action_class_entropy",),
    "hist_modal_hour": ("modal_hour_deviation",),
    "hist_log_total": ("log_action_history",),
    "cyclic_time": ("hour_sin", "hour_cos", "dow_sin", "dow_cos"),
    "org_identity_flags": ("principal_type", "cross_account_depth", "is_supervisor"),
    "cross_unit_flag": ("cross_account_flag", "is_session_action", "is_egress_action", "resource_sensitivity"),
    "path_depth": ("arn_prefix_depth",),
    "window_counts_1m_15m_60m": ("calls_1min", "calls_15min", "calls_60min"),
    "window_bytes": ("log_bytes_read_60min",),
    "window_distinct": ("distinct_resources_60min", "distinct_actions_60min"),
    "net_novelty": ("asn_novelty", "host_novelty", "device_fingerprint_match"),
    "net_geodesic": ("geodesic_distance_km",),
    "asof_last_session": ("log_mfa_age",),
    "feature_row_full": M.FEATURES,
}


def _features(spark, d, names: tuple[str, ...] = M.FEATURES, **how) -> DataFrame:
    return history.spread_features(proxy.events(spark, d), names, counted=proxy.raw_events(spark, d), **how)


def _family(names: tuple[str, ...]) -> Query:
    return lambda spark, d: rnd(_features(spark, d, names, keep=("event_id", "principal")).select("event_id", "principal", *names), *names)


for _name, _cols in _FAMILIES.items():
    query(f"WITH {FEAT} SELECT event_id, principal, {rounded(_cols)} FROM feat", _name)(_family(_cols))


@query(f"WITH {FEAT} SELECT event_id, principal, {rounded(M.FEATURES)} FROM feat")
def feature_row_in_chunks(spark, d):
    """All features, with every principal of more than 20 events cut into chunks of time."""
    return rnd(_features(spark, d, rows=20, keep=("event_id", "principal")).select("event_id", "principal", *M.FEATURES), *M.FEATURES)


@query(f"WITH {EV} SELECT event_id, principal, count(*) OVER (PARTITION BY principal ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS n_1h, count(*) OVER (PARTITION BY principal ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) - 1 AS n_1d, count(*) OVER (PARTITION BY principal ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) - 1 AS n_7d FROM ev")
def window_counts_1h_1d_7d(spark, d):
    return history.window_counts(proxy.raw_events(spark, d).select("event_id", "ts", "principal"), {"n_1h": 3600, "n_1d": 86400, "n_7d": 7 * 86400})


# --- roll-ups ------------------------------------------------------------------------------


_DAYS = (
    FEAT
    + """, hrs AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, round(CASE WHEN a < 0 THEN a + 24 ELSE a END, 6) AS hr FROM (SELECT *, atan2(hour_sin, hour_cos) / (2 * pi()) * 24 AS a FROM feat)),
days AS (SELECT principal, day, CAST(max(label) AS INT) AS label, count(*) AS n_events, ln(1 + count(*)) AS log_n_events, avg(CASE WHEN hr < 6 OR hr >= 22 THEN 1.0 ELSE 0.0 END) AS after_hours_frac, """
    + ", ".join(f"avg({f}) AS mean_{f}" for f in M.FEATURES)
    + ", "
    + ", ".join(f"max({f}) AS max_{f}" for f in M.FEATURES)
    + ", "
    + ", ".join(f"ln(1 + sum({f})) AS log_count_{f}" for f in M.DAY_FLAGS)
    + " FROM hrs GROUP BY 1, 2)"
)
DAY_COLUMNS = ("log_n_events", "after_hours_frac", *(f"mean_{f}" for f in M.FEATURES), *(f"max_{f}" for f in M.FEATURES), *(f"log_count_{f}" for f in M.DAY_FLAGS))


@query(f"WITH {_DAYS} SELECT principal, day, label, n_events, {rounded(DAY_COLUMNS, 5)} FROM days")
def userday_rollup(spark, d):
    return rnd(rollup.user_days(_features(spark, d)), *DAY_COLUMNS, places=5)


_FEW = ("role_tenure_days", "log_inter_request_gap", "action_frequency", "geodesic_distance_km", "log_mfa_age", "calls_60min")


@query(f"WITH {FEAT}, s AS (SELECT {_SPLIT} AS split, * FROM feat) " + " UNION ALL ".join(f"SELECT split, '{c}' AS feature, count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std, round(min({c}), 5) AS min, round(max({c}), 5) AS max, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 5) AS zero_frac FROM s GROUP BY 1" for c in _FEW))
def feature_stats_long(spark, d):
    e = _features(spark, d).withColumn("split", rollup.time_split(F.col("ts"), START, SPANS))
    return rnd(rollup.feature_stats(e, _FEW, "split"), "mean", "std", "min", "max", "zero_frac", places=5)


@query(f"WITH {FEAT}, s AS (SELECT * FROM feat WHERE {_SPLIT} = 'train' AND label = 0) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 5) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-8 THEN 1 ELSE stddev_pop({c}) END, 5) AS std FROM s" for c in M.CONTINUOUS))
def standardiser_fit(spark, d):
    e = _features(spark, d).where((rollup.time_split(F.col("ts"), START, SPANS) == "train") & (F.col("label") == 0))
    return rnd(rollup.moments(e, M.CONTINUOUS), "mean", "std", places=5)


@query(f"WITH {FEAT}, t AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-8 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _FEW) + f" FROM feat WHERE {_SPLIT} = 'train' AND label = 0) SELECT event_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 5) AS {c}" for c in _FEW) + " FROM feat CROSS JOIN t")
def standardise_apply(spark, d):
    e = _features(spark, d)
    train = e.where((rollup.time_split(F.col("ts"), START, SPANS) == "train") & (F.col("label") == 0))
    return rnd(rollup.standardise(e.select("event_id", *_FEW), train, _FEW), *_FEW, places=5)


_DFEW = ("log_n_events", "after_hours_frac", "mean_action_frequency", "max_geodesic_distance_km", "log_count_host_novelty")


@query(f"WITH {_DAYS}, t AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-8 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _DFEW) + " FROM days) SELECT principal, day, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 5) AS {c}" for c in _DFEW) + " FROM days CROSS JOIN t")
def userday_standardise(spark, d):
    days = rollup.user_days(_features(spark, d)).select("principal", "day", *_DFEW)
    return rnd(rollup.standardise(days, days, _DFEW), *_DFEW, places=5)


_START = "epoch_us((SELECT min(ts) FROM ev))"


@query(f"WITH {EV}, s AS (SELECT CASE WHEN epoch_us(ts) < {_START} + {int(SPANS[0] * 86400e6)} THEN 'train' WHEN epoch_us(ts) < {_START} + {int((SPANS[0] + SPANS[1]) * 86400e6)} THEN 'val' ELSE 'test' END AS split FROM ev) SELECT split, count(*) AS n, CAST((SELECT min(ts) FROM ev) AS TIMESTAMP) AS start FROM s GROUP BY 1")
def corpus_start_split(spark, d):
    e = proxy.raw_events(spark, d)
    n = rollup.split_from_start(e, SPANS).groupBy("split").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(rollup.corpus_start(e))).select("split", "n", F.col("start").cast("timestamp_ntz").alias("start"))  # a single row


_UD = "ud AS (SELECT principal, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(label) AS label FROM ev GROUP BY 1, 2)"


def _user_day_counts(spark, d) -> DataFrame:
    return proxy.raw_events(spark, d).groupBy("principal", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max("label").alias("label"))


@query(f"WITH {EV}, {_UD}, q AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM ud)), c AS (SELECT day AS cut FROM q WHERE i = n // 2 + 1) SELECT CASE WHEN day < cut THEN 'early' ELSE 'late' END AS side, count(*) AS days, CAST(sum(n) AS BIGINT) AS events FROM ud CROSS JOIN c GROUP BY 1")
def userday_median_split(spark, d):
    return rollup.median_day_split(_user_day_counts(spark, d)).groupBy("side").agg(F.count("*").alias("days"), F.sum("n").alias("events"))


def _plain_days(cls: str) -> str:
    return f"SELECT principal, strftime(ts, '%Y-%m-%d') AS day, {cls} AS label, count(*) AS n_events, round(avg(is_egress_action), 6) AS mean_is_egress_action, max(is_session_action) AS max_is_session_action FROM feat WHERE label = {cls} GROUP BY 1, 2"


@query(f"WITH {FEAT} {_plain_days('0')} UNION ALL {_plain_days('1')}")
def training_days_union(spark, d):
    t = rollup.training_days(_features(spark, d, ("is_egress_action", "is_session_action", "first_time_action", "first_time_resource", "host_novelty", "hour_sin", "hour_cos")), ("is_egress_action", "is_session_action"))
    return rnd(t.select("principal", "day", "label", "n_events", "mean_is_egress_action", "max_is_session_action"), "mean_is_egress_action")


@query(f"WITH {EV}, {_UD} SELECT principal, day, n, label, true AS reused FROM ud")
def userday_cache_round_trip(spark, d):
    """The days come from a cache; the second time they are read, not made."""
    path = scratch(spark, "user-days")
    sinks.cached(spark, path, lambda: _user_day_counts(spark, d))
    made = []
    again = sinks.cached(spark, path, lambda: made.append(1) or _user_day_counts(spark, d))
    return again.withColumn("reused", F.lit(not made))


#: A stand-in risk: a deterministic number in [0, 1) from the ids, in exact arithmetic on both sides.
_R = "CAST((event_id * 7919 + bytes_read * 31) % 1000 AS DOUBLE) / 1000"


def risk() -> F.Column:
    return ((F.col("event_id") * 7919 + F.col("bytes_read") * 31) % 1000).cast("double") / 1000


@query(f"WITH {EV}, q AS (SELECT event_id, principal, strftime(ts, '%Y-%m-%d') AS day, {_R} AS r FROM ev), dd AS (SELECT principal, day, max(r) * 0.9 AS r FROM q GROUP BY 1, 2 HAVING count(*) > 1) SELECT event_id, round(q.r, 6) AS r, round(coalesce(dd.r, 0), 6) AS r_day, round(greatest(q.r, coalesce(dd.r, 0)), 6) AS r_max FROM q LEFT JOIN dd ON q.principal = dd.principal AND q.day = dd.day")
def userday_propagate_max(spark, d):
    q = proxy.raw_events(spark, d).select("event_id", "principal", F.date_format("ts", "yyyy-MM-dd").alias("day"), risk().alias("r"))
    days = q.groupBy("principal", "day").agg((F.max("r") * 0.9).alias("r"), F.count("*").alias("n")).where("n > 1")
    return rnd(rollup.propagate(q, days).select("event_id", "r", "r_day", "r_max"), "r", "r_day", "r_max")


@query(f"WITH {EV}, b AS (SELECT * FROM ev WHERE label = 1), s AS (SELECT principal, string_agg(source || '=' || c, ',' ORDER BY source) AS by_source FROM (SELECT principal, source, count(*) AS c FROM b GROUP BY 1, 2) GROUP BY 1) SELECT b.principal, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, CAST(min(ts) AS TIMESTAMP) AS first, CAST(max(ts) AS TIMESTAMP) AS last, any_value(by_source) AS by_source FROM b JOIN s USING (principal) GROUP BY 1 ORDER BY n DESC, b.principal LIMIT 8")
def insider_ranking_topk(spark, d):
    t = rollup.insiders(proxy.raw_events(spark, d))
    text = F.array_join(F.transform(F.map_entries("by_source"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return t.select("principal", "n", "days", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), text.alias("by_source"))


@query(f"WITH {EV}, o AS (SELECT * FROM ev WHERE principal = '7'), s AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS z FROM o WHERE action = 'sts:SessionEnd' AND bytes_read > 60) SELECT event_id, action FROM o CROSS JOIN s WHERE CAST(ts AS DATE) >= a - 3 AND CAST(ts AS DATE) < z + 4")
def scenario_window_extract(spark, d):
    e = proxy.raw_events(spark, d).withColumn("label", F.when((F.col("action") == "sts:SessionEnd") & (F.col("bytes_read") > 60), 1).otherwise(0))
    return rollup.scenario(e, "7").select("event_id", "action")


_BAND = "CASE WHEN {r} >= 0.85 THEN 'DENY' WHEN {r} >= 0.65 THEN 'STEPUP' WHEN {r} >= 0.4 THEN 'ALLOW_OBSERVE' ELSE 'ALLOW' END"
_TRUST = f"least(1, greatest(0, (1 - pow(1 - {_R}, 1 + 1.5 * {SENSITIVITY})) * (1 - 0.25 * (event_id % 3) / 2.0)))"


def effective() -> F.Column:
    s = C.sensitivity(F.col("action"), F.col("resource"), F.col("egress"))
    return F.round(C.effective_risk(risk(), s, (F.col("event_id") % 3) / 2.0), 9)


@query(f"WITH {EV}, t AS (SELECT strftime(ts, '%Y-%m-%d') AS day, label, round({_TRUST}, 9) AS rr FROM ev) SELECT day, count(*) AS events, CAST(sum(label) AS BIGINT) AS malicious, round(max(rr), 6) AS peak, " + ", ".join(f"CAST(sum(CASE WHEN {_BAND.format(r='rr')} = '{b.verdict}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{b.verdict}\"" for b in M.BANDS) + " FROM t GROUP BY 1")
def day_verdict_summary(spark, d):
    t = proxy.events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "label", effective().alias("rr"))
    v = C.band(F.col("rr"))
    return t.groupBy("day").agg(F.count("*").alias("events"), F.sum("label").cast("long").alias("malicious"), F.round(F.max("rr"), 6).alias("peak"), *[F.count(F.when(v == b.verdict, 1)).alias(b.verdict) for b in M.BANDS])


@query(f"WITH {EV}, t AS (SELECT principal, strftime(ts, '%Y-%m-%d') AS day, event_id, round({_TRUST}, 9) AS rr FROM ev) SELECT principal, day, event_id, rr FROM (SELECT *, row_number() OVER (PARTITION BY principal, day ORDER BY rr DESC, event_id) AS i FROM t) WHERE i = 1")
def peak_row_selection(spark, d):
    t = proxy.events(spark, d).select("principal", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", effective().alias("rr"))
    best = t.groupBy("principal", "day").agg(F.max(F.struct("rr", (-F.col("event_id")).alias("i"))).alias("b"))
    return best.select("principal", "day", (-F.col("b.i")).alias("event_id"), F.col("b.rr").alias("rr"))


# --- scores, trust, metrics ----------------------------------------------------------------


@query(f"WITH {EV}, c AS (SELECT {_R} AS v FROM ev WHERE event_id % 4 = 0), q AS (SELECT event_id, {_R} AS v FROM ev WHERE event_id % 4 <> 0) SELECT event_id, round((SELECT count(*) FROM c WHERE c.v <= q.v)::DOUBLE / (SELECT count(*) FROM c), 6) AS f FROM q")
def ecdf_global(spark, d):
    t = proxy.raw_events(spark, d).select("event_id", risk().alias("v"))
    return rnd(calibrate.ecdf(t.where("event_id % 4 = 0"), t.where("event_id % 4 <> 0"), "v").select("event_id", "f"), "f")


@query(f"WITH {EV}, t AS (SELECT event_id, action AS kind, {_R} AS v FROM ev), c AS (SELECT * FROM t WHERE event_id % 4 = 0 AND (kind <> 's3:PutObject' OR event_id % 16 = 0)), q AS (SELECT * FROM t WHERE event_id % 4 <> 0) SELECT event_id, round(CASE WHEN (SELECT count(*) FROM c WHERE c.kind = q.kind) >= 200 THEN (SELECT count(*) FROM c WHERE c.kind = q.kind AND c.v <= q.v)::DOUBLE / (SELECT count(*) FROM c WHERE c.kind = q.kind) ELSE (SELECT count(*) FROM c WHERE c.v <= q.v)::DOUBLE / (SELECT count(*) FROM c) END, 6) AS f FROM q")
def ecdf_by_type_with_fallback(spark, d):
    t = proxy.raw_events(spark, d).select("event_id", F.col("action").alias("kind"), risk().alias("v"))
    c = t.where("event_id % 4 = 0").where("kind <> 's3:PutObject' or event_id % 16 = 0")
    return rnd(calibrate.ecdf_with_fallback(c, t.where("event_id % 4 <> 0"), "v", "kind").select("event_id", "f"), "f")


@query(f"WITH {EV} SELECT event_id, round(least(1, greatest(0, 0.6 * {_R} + 0.4 * (event_id % 11) / 10.0)), 6) AS r FROM ev")
def fuse_scores(spark, d):
    return rnd(proxy.raw_events(spark, d).select("event_id", C.fuse(risk(), (F.col("event_id") % 11) / 10.0).alias("r")), "r")


@query(f"WITH {EV} SELECT event_id, round({_TRUST}, 6) AS r_eff, round(least(1, greatest(0, 1 - pow(1 - {_R}, 1 + 1.5 * {SENSITIVITY}) * (1 - 0.25 * (event_id % 3) / 2.0))), 6) AS r_literal FROM ev")
def trust_transform(spark, d):
    s, c = C.sensitivity(F.col("action"), F.col("resource"), F.col("egress")), (F.col("event_id") % 3) / 2.0
    return rnd(proxy.events(spark, d).select("event_id", C.effective_risk(risk(), s, c).alias("r_eff"), C.effective_risk(risk(), s, c, literal=True).alias("r_literal")), "r_eff", "r_literal")


_BANDS_SQL = "(VALUES (0.0, 'ALLOW', 60, 'as_requested'), (0.4, 'ALLOW_OBSERVE', 30, 'as_requested_verbose'), (0.65, 'STEPUP', 15, 'read_only'), (0.85, 'DENY', NULL, 'none')) b(lower, verdict, ttl, scope)"
_BAND_ROWS = f"WITH {EV}, t AS (SELECT event_id, {_R} AS r FROM ev) SELECT event_id, arg_max(verdict, lower) AS verdict, CAST(arg_max_null(ttl, lower) AS INT) AS ttl_minutes, arg_max(scope, lower) AS scope FROM t JOIN {_BANDS_SQL} ON b.lower <= t.r GROUP BY 1"


@query(_BAND_ROWS)
def band_lookup_case(spark, d):
    r = risk()
    return proxy.raw_events(spark, d).select("event_id", C.band(r).alias("verdict"), C.band(r, "ttl_minutes").alias("ttl_minutes"), C.band(r, "scope").alias("scope"))


@query(_BAND_ROWS)
def band_lookup_range_join(spark, d):
    bands = spark.createDataFrame([(b.lower, b.verdict, b.ttl_minutes, b.scope) for b in M.BANDS], "lower double, verdict string, ttl_minutes int, scope string")
    bands = bands.withColumn("upper", F.lead("lower", 1, 2.0).over(Window.orderBy("lower")))  # four rows
    t = proxy.raw_events(spark, d).select("event_id", risk().alias("r"))
    return t.join(F.broadcast(bands), (F.col("lower") <= F.col("r")) & (F.col("r") < F.col("upper"))).select("event_id", "verdict", "ttl_minutes", "scope")


@query("SELECT event_id, round(CASE WHEN event_id % 2 = 0 AND event_id % 7 <> 0 THEN least(1, 0.6 * f + CASE WHEN event_id % 3 = 0 THEN 0.4 * f ELSE 0 END) ELSE 0 END, 6) AS credit FROM (SELECT event_id, greatest(0, 1 - greatest(0, (event_id * 37) % 40000 - 500) / 28800.0) AS f FROM events)")
def control_credit(spark, d):
    i = F.col("event_id")
    age = F.when(i % 7 != 0, ((i * 37) % 40000 - 500).cast("double"))
    return rnd(proxy.table(spark, d, "events").select("event_id", C.control_credit(i % 2 == 0, age, i % 3 == 0).alias("credit")), "credit")


#: Scores that lean towards the label, with ties.
_SCORE = f"round(least(1.0, {_R} * 0.8 + 0.2 * label), 2)"


def scored(spark, d) -> DataFrame:
    return proxy.raw_events(spark, d).select("event_id", "source", "action", F.col("label").alias("y"), F.round(F.least(F.lit(1.0), risk() * 0.8 + 0.2 * F.col("label")), 2).alias("score"))


_SC = f"{EV}, sc AS (SELECT event_id, source, action, label AS y, {_SCORE} AS score FROM ev)"


@query(f"WITH {_SC}, c AS (SELECT source, sum(CASE WHEN score >= 0.85 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.85 AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN score < 0.85 AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN score < 0.85 AND y = 0 THEN 1 ELSE 0 END) AS tn FROM sc GROUP BY 1), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c) SELECT source, round(pr, 6)::DOUBLE AS precision, round(re, 6)::DOUBLE AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6)::DOUBLE AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6)::DOUBLE AS fpr, CAST(tp + fn AS BIGINT) AS positives, CAST(tp + fp AS BIGINT) AS predicted_positive FROM p")
def metrics_at_threshold(spark, d):
    return rnd(metrics.at_threshold(scored(spark, d), by=("source",)), "precision", "recall", "f1", "fpr")


@query(f"WITH {_SC}, t AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM sc GROUP BY 1) SELECT score, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(q) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM t")
def roc_curve(spark, d):
    return metrics.roc_curve(scored(spark, d))


_AUC = "(sum(p * (under + q / 2.0)) / (sum(p) * sum(q)))"


def _auc(by: str, src: str) -> str:
    return f"t AS (SELECT {by}, score, sum(y) AS p, sum(1 - y) AS q FROM {src} GROUP BY 1, 2), u AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM t) SELECT {by}, round(CASE WHEN sum(p) * sum(q) > 0 THEN {_AUC} END, 6)::DOUBLE AS auc FROM u GROUP BY 1"


@query(f"WITH {_SC}, {_auc('action', 'sc')}")
def roc_auc(spark, d):
    return rnd(metrics.roc_auc(scored(spark, d), ("action",)), "auc")


@query(f"WITH {_SC}, g AS (SELECT *, unnest(CASE WHEN source = 'http' THEN [source, 'all'] ELSE [source, 'all', 'non-http'] END) AS grp FROM sc), {_auc('grp', 'g')}")
def auc_by_overlapping_group(spark, d):
    return rnd(metrics.roc_auc(metrics.in_groups(scored(spark, d), F.col("source")), ("grp",)), "auc")


@query(f"WITH {_SC}, g AS (SELECT *, unnest(CASE WHEN source = 'http' THEN [source, 'all'] ELSE [source, 'all', 'non-http'] END) AS grp FROM sc), m AS (SELECT grp, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, round(avg(CASE WHEN y = 0 THEN score END), 6) AS benign_mean, round(avg(CASE WHEN y = 1 THEN score END), 6) AS malicious_mean FROM g GROUP BY 1), a AS (WITH {_auc('grp', 'g')}) SELECT m.*, a.auc FROM m JOIN a USING (grp)")
def auc_and_means_by_group(spark, d):
    return rnd(metrics.by_group_with_means(scored(spark, d)), "benign_mean", "malicious_mean", "auc")


@query(f"WITH {_SC}, t AS (SELECT source, score, sum(y) AS p, sum(1 - y) AS q FROM sc GROUP BY 1, 2), c AS (SELECT source, score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY source) AS pos FROM t WINDOW w AS (PARTITION BY source ORDER BY score DESC)), f AS (SELECT *, CASE WHEN pos > 0 THEN round(2.0 * tp / (tp + fp + pos), 12) ELSE 0 END AS f1 FROM c) SELECT source, CASE WHEN pos > 0 THEN least(1, greatest(0, score)) ELSE 0.85 END::DOUBLE AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f1 DESC, score DESC) AS i FROM f) WHERE i = 1")
def best_f1_threshold(spark, d):
    return metrics.best_f1_threshold(scored(spark, d), ("source",))


@query(f"WITH {_SC}, s AS (SELECT event_id % 5 AS seed, action, avg(score) AS v FROM sc WHERE NOT (action = 's3:PutObject' AND event_id % 5 > 0) GROUP BY 1, 2) SELECT action, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM s GROUP BY 1")
def seed_summary(spark, d):
    s = scored(spark, d).where("not (action = 's3:PutObject' and event_id % 5 > 0)").groupBy((F.col("event_id") % 5).alias("seed"), "action").agg(F.avg("score").alias("v"))
    return rnd(metrics.seed_summary(s, "v", ("action",)), "mean", "std")


# --- policy --------------------------------------------------------------------------------

_OWN = "coalesce(unit_bucket, '')"
_BUCKET = "split_part(split_part(resource, ':::', 2), '/', 1)"
#: An own policy document for the queries below.
POLICY = {
    "roles": {
        "staff": {"allow": [
            {"actions": ["execute-api:*"], "resources": ["arn:aws:execute-api:::site-1*"]},
            {"actions": ["s3:Get*", "s3:Put*"], "resources": ["arn:aws:s3:::*/docs/*"], "condition": {"own_unit_bucket": True}},
            {"actions": ["sts:AssumeRole"], "resources": ["*-session"]},
        ]},
        "operator": {"allow": [{"actions": ["s3:*"], "resources": ["*"], "condition": {"require_managed_device": True}}, {"actions": ["*"], "resources": ["*"]}]},
    },
    "sensitivity": {"default": 0.35, "rules": [{"pattern": "*/removable/f1*", "value": 0.95}, {"pattern": "*/docs/*", "value": 0.7}, {"pattern": "arn:aws:iam::*session", "value": 0.2}, {"pattern": "*:::site-?", "value": 0.45}]},
}
_ROLE = "CASE WHEN role = 'ITAdmin' THEN 'operator' WHEN role = 'Director' THEN 'guest' ELSE 'staff' END"
_PERMIT = f"""WITH {EV}, q AS (SELECT *, {_ROLE} AS rl, event_id % 2 = 0 AS managed FROM ev), p AS (SELECT event_id, rl, action, resource, CASE
 WHEN rl = 'guest' THEN 0 WHEN rl = 'staff' AND starts_with(action, 'execute-api:') AND starts_with(resource, 'arn:aws:execute-api:::site-1') THEN 1
 WHEN rl = 'staff' AND (starts_with(action, 's3:Get') OR starts_with(action, 's3:Put')) AND regexp_matches(resource, '^arn:aws:s3:::.*/docs/.*$') THEN CASE WHEN {_OWN} <> '' AND {_BUCKET} = {_OWN} THEN 1 ELSE 2 END
 WHEN rl = 'staff' AND action = 'sts:AssumeRole' AND ends_with(resource, '-session') THEN 1
 WHEN rl = 'operator' AND starts_with(action, 's3:') THEN CASE WHEN managed THEN 1 ELSE 3 END WHEN rl = 'operator' THEN 1 ELSE 4 END AS c, {_OWN} AS own, {_BUCKET} AS b FROM q)
SELECT event_id, c = 1 AS allowed, CASE c WHEN 0 THEN 'the policy has no role ' || rl WHEN 1 THEN 'granted to ' || rl WHEN 2 THEN b || ' is outside the unit''s own ' || own WHEN 3 THEN 'only from a managed device' ELSE 'nothing lets ' || rl || ' do ' || action || ' with ' || resource END AS reason FROM p"""


@query(_PERMIT)
def policy_permit_first_match(spark, d):
    role = F.when(F.col("role") == "ITAdmin", "operator").when(F.col("role") == "Director", "guest").otherwise("staff")
    p = policy.permit(role, F.col("action"), F.col("resource"), F.col("unit_bucket"), F.col("event_id") % 2 == 0, POLICY)
    return proxy.events(spark, d).select("event_id", p.alias("p")).select("event_id", "p.allowed", "p.reason")


_POLICY_SENSITIVITY = "CASE WHEN regexp_matches(resource, '^.*/removable/f1.*$') THEN 0.95 WHEN regexp_matches(resource, '^.*/docs/.*$') THEN 0.7 WHEN regexp_matches(resource, '^arn:aws:iam::.*session$') THEN 0.2 WHEN regexp_matches(resource, '^.*:::site-.$') THEN 0.45 ELSE 0.35 END::DOUBLE"


@query(f"WITH {EV} SELECT event_id, {_POLICY_SENSITIVITY} AS sensitivity FROM ev")
def policy_sensitivity_first_match(spark, d):
    return proxy.events(spark, d).select("event_id", policy.sensitivity(F.col("resource"), POLICY).cast("double").alias("sensitivity"))


# --- requests ------------------------------------------------------------------------------

_RQ = f"{EV}, rq AS (SELECT event_id, ts, principal, action, resource, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE pc END AS device_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE '10.0.0.' || (event_id % 250) END AS source_ip, CASE WHEN event_id % 5 > 0 THEN bytes_read END AS bytes_requested FROM ev)"


def access_requests(spark, d) -> DataFrame:
    i = F.col("event_id")
    device = F.when(i % 3 == 1, "").when(i % 3 == 2, F.col("pc"))
    return proxy.events(spark, d).select("event_id", "ts", "principal", "action", "resource", device.alias("device_id"), F.when(i % 4 != 0, F.concat(F.lit("10.0.0."), (i % 250).cast("string"))).alias("source_ip"), F.when(i % 5 > 0, F.col("bytes_read")).alias("bytes_requested"))


@query(f"WITH {_RQ} SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, principal, action, resource, 'pdp' AS source, coalesce(nullif(device_id, ''), nullif(source_ip, ''), '') AS pc, action = 'execute-api:Invoke' OR contains(resource, '/removable/') AS egress, coalesce(bytes_requested, 0) AS bytes_read FROM rq")
def request_event_mapping(spark, d):
    return requests.to_events(access_requests(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {FEAT} SELECT event_id, {_POLICY_SENSITIVITY} AS resource_sensitivity, round(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE device_fingerprint_match END, 6)::DOUBLE AS device_fingerprint_match, round(CASE WHEN event_id % 3 > 0 THEN ln(1 + greatest(0, event_id % 5000 - 100)) ELSE log_mfa_age END, 6) + 0.0::DOUBLE AS log_mfa_age FROM feat")
def live_overrides(spark, d):
    i = F.col("event_id")
    e = _features(spark, d, ("device_fingerprint_match", "log_mfa_age"))
    live = requests.overridden(policy.sensitivity(F.col("resource"), POLICY), i % 2 == 0, F.when(i % 3 > 0, (i % 5000 - 100).cast("double")))
    return rnd(e.select("event_id", *[c.alias(n) for n, c in live.items()]), "device_fingerprint_match", "log_mfa_age")


# --- reports -------------------------------------------------------------------------------


@query(f"WITH {_SC}, v AS (SELECT action AS model, CASE event_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'per_type' ELSE 'per_model' END AS variant, score FROM sc), m AS (SELECT model, variant, avg(score) AS s FROM v GROUP BY 1, 2) SELECT model, round(max(CASE WHEN variant = 'global' THEN s END), 6) AS global, round(max(CASE WHEN variant = 'per_type' THEN s END), 6) AS per_type, round(max(CASE WHEN variant = 'per_model' THEN s END), 6) AS per_model FROM m GROUP BY 1")
def variant_side_by_side(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, "global").when(F.col("event_id") % 3 == 1, "per_type").otherwise("per_model")
    t = scored(spark, d).withColumn("variant", v).groupBy(F.col("action").alias("model")).pivot("variant", ["global", "per_type", "per_model"]).agg(F.avg("score"))
    return rnd(t, "global", "per_type", "per_model")


@query(f"WITH {EV}, t AS (SELECT action, count(*)::DOUBLE / (SELECT count(*) FROM ev) AS share FROM ev GROUP BY 1) SELECT action, round(share, 6) AS share FROM t")
def global_action_distribution(spark, d):
    t = proxy.raw_events(spark, d).groupBy("action").agg(F.count("*").alias("n"))
    return t.select("action", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # one row an action


@query(f"WITH {EV}, t AS (SELECT action, count(*)::DOUBLE / (SELECT count(*) FROM ev) AS share FROM ev WHERE {_SPLIT} = 'train' GROUP BY 1) SELECT event_id, round(coalesce(share, 0), 6) AS action_frequency FROM ev LEFT JOIN t USING (action)")
def global_frequency_substitution(spark, d):
    e = proxy.raw_events(spark, d)
    n = e.agg(F.count("*").alias("_n"))
    train = e.where(rollup.time_split(F.col("ts"), START, SPANS) == "train").groupBy("action").agg(F.count("*").alias("c")).join(F.broadcast(n))  # a single row
    t = train.select("action", (F.col("c") / F.col("_n")).alias("share"))
    return e.join(F.broadcast(t), "action", "left").select("event_id", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("action_frequency"))  # one row an action


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return rnd(metrics.percentiles(proxy.table(spark, d, "events").withColumnRenamed("event_type", "stage"), "value", ("stage",)), "p50", "p95", "mean")


@query("SELECT user_id % 5 AS rate, event_type AS stage, count(*) AS n, round(count(*) / 20.0, 6)::DOUBLE AS tps, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2")
def throughput_by_rate(spark, d):
    e = proxy.table(spark, d, "events").select((F.col("user_id") % 5).alias("rate"), F.col("event_type").alias("stage"), "value")
    n = e.groupBy("rate", "stage").agg(F.count("*").alias("n"), F.round(F.count("*") / 20.0, 6).alias("tps"))
    return rnd(n.join(quantiles(e, "value", {"p50": 0.5, "p95": 0.95}, ("rate", "stage")), ["rate", "stage"]), "p50", "p95")


@query(f"WITH {_SC}, s AS (SELECT source, min(event_id) AS first_seen, arg_min(score, event_id) AS first, avg(score) AS mean, stddev_samp(score) AS std FROM sc GROUP BY 1) SELECT source, first, round(mean, 6) AS mean, round(std, 6) AS std, row_number() OVER (ORDER BY first_seen) AS place FROM s")
def label_drift_summary(spark, d):
    s = scored(spark, d).groupBy("source").agg(F.min("event_id").alias("i"), F.min_by("score", "event_id").alias("first"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    return rnd(s.select("source", "first", "mean", "std", F.row_number().over(Window.orderBy("i")).cast("long").alias("place")), "mean", "std")  # one row a source


@query(f"WITH {EV}, t AS (SELECT CASE event_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'modify' WHEN 2 THEN 'backdate' ELSE 'fabricate' END AS kind, event_id % 3 <> 0 AS ok, event_id % 5 <> 0 AS found FROM ev) SELECT coalesce(kind, 'total') AS kind, count(*) AS attempts, CAST(sum(ok::INT) AS BIGINT) AS succeeded, CAST(sum((ok AND found)::INT) AS BIGINT) AS detected FROM t GROUP BY ROLLUP (kind)")
def tamper_rollup(spark, d):
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "delete").when(i % 4 == 1, "modify").when(i % 4 == 2, "backdate").otherwise("fabricate")
    t = proxy.raw_events(spark, d).select(kind.alias("kind"), (i % 3 != 0).alias("ok"), (i % 5 != 0).alias("found"))
    return t.rollup("kind").agg(F.count("*").alias("attempts"), F.sum(F.col("ok").cast("long")).alias("succeeded"), F.sum((F.col("ok") & F.col("found")).cast("long")).alias("detected")).withColumn("kind", F.coalesce("kind", F.lit("total")))


@query(f"WITH {EV}, t AS (SELECT principal, strftime(ts, '%Y-%m-%d') AS day, {_BAND.format(r=f'round({_TRUST}, 9)')} AS verdict FROM ev) SELECT principal, day, verdict, count(*) AS n FROM t GROUP BY 1, 2, 3")
def verdicts_by_principal_day(spark, d):
    return proxy.events(spark, d).groupBy("principal", F.date_format("ts", "yyyy-MM-dd").alias("day"), C.band(effective()).alias("verdict")).agg(F.count("*").alias("n"))
