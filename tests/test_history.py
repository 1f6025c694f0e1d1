import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import history

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)


def make(spark, rows):
    """rows: (id, seconds, principal, action, resource, pc, bytes)"""
    data = [(i, T0 + dt.timedelta(seconds=s), p, a, r, pc, b, "logon", False, 0, "Clerk", "B", "F", "", "", "S", "org-f", True) for i, s, p, a, r, pc, b in rows]
    cols = "event_id long, ts timestamp, principal string, action string, resource string, pc string, bytes_read long, source string, egress boolean, label int, role string, business_unit string, functional_unit string, department string, team string, supervisor string, unit_bucket string, known boolean"
    return spark.createDataFrame(data, cols)


def features(spark, rows):
    return {r["event_id"]: r for r in history.features(make(spark, rows)).collect()}


def test_first_event_has_no_history(spark):
    f = features(spark, [(1, 0, "p", "sts:AssumeRole", "r", "x", 5)])[1]
    assert (f["action_frequency"], f["resource_novelty"], f["read_write_ratio"], f["action_class_entropy"], f["modal_hour_deviation"]) == (0, 1, 0.5, 0, 0)
    assert (f["role_tenure_days"], f["log_inter_request_gap"], f["log_mfa_age"], f["geodesic_distance_km"], f["calls_60min"]) == (0, 0, 0, 0, 0)
    assert (f["first_time_action"], f["first_time_resource"], f["host_novelty"], f["asn_novelty"]) == (1, 1, 1, 1)


def test_half_life(spark):
    day = 86400
    f = features(spark, [(1, 0, "p", "s3:GetObject", "a", "x", 0), (2, 30 * day, "p", "s3:PutObject", "b", "x", 0), (3, 30 * day, "p", "s3:GetObject", "a", "x", 0)])
    assert f[2]["log_action_history"] == pytest.approx(0.4054651081)  # log1p(0.5)
    assert f[3]["action_frequency"] == pytest.approx(0.5 / 1.5)
    assert f[3]["role_tenure_days"] == 30


def test_windows_are_anchored_on_the_request(spark):
    rows = [(i, 30 * i, "p", "s3:GetObject", f"r{i}", "x", 10) for i in range(11)]
    f = features(spark, rows)[10]
    assert (f["calls_1min"], f["calls_15min"], f["calls_60min"], f["distinct_resources_60min"], f["distinct_actions_60min"]) == (2, 10, 10, 10, 1)
    burst = [(i, i, "p", "s3:GetObject", "r", "x", 1) for i in range(30)] + [(99, 30, "p", "s3:GetObject", "r", "x", 1)]
    assert features(spark, burst)[99]["calls_1min"] == 30


def test_events_of_the_same_moment_follow_their_ids(spark):
    f = features(spark, [(1, 0, "p", "s3:GetObject", "a", "x", 1), (2, 0, "p", "s3:GetObject", "a", "x", 1)])
    assert (f[1]["calls_60min"], f[2]["calls_60min"]) == (0, 1)
    assert (f[1]["resource_novelty"], f[2]["resource_novelty"]) == (1, 0)
    w = {r["event_id"]: r["n"] for r in history.window_counts(make(spark, [(1, 0, "p", "a", "a", "x", 1), (2, 0, "p", "a", "a", "x", 1), (3, 10, "p", "a", "a", "x", 1)]), {"n": 60}).collect()}
    assert w == {1: 0, 2: 1, 3: 2}


def test_principals_do_not_mix_and_nothing_leaks_from_the_future(spark):
    rows = [(i, 60 * i, "p" if i % 2 else "q", "s3:GetObject", f"r{i % 3}", f"pc{i % 4}", i) for i in range(20)]
    whole, part = features(spark, rows), features(spark, rows[:12])
    assert all(whole[i] == part[i] for i in part)
    alone = features(spark, [r for r in rows if r[2] == "p"])
    assert all(whole[i] == alone[i] for i in alone)


def test_empty_host_is_always_new(spark):
    f = features(spark, [(1, 0, "p", "s3:GetObject", "a", "", 1), (2, 5, "p", "s3:GetObject", "a", "", 1)])
    assert [f[i]["host_novelty"] for i in (1, 2)] == [1, 1] and f[2]["device_fingerprint_match"] == 0


def test_one_exchange_serves_all_windows(spark):
    plan = history.features(make(spark, [(1, 0, "p", "a", "r", "x", 1)])).select("event_id", "action_frequency", "resource_novelty", "calls_60min", "host_novelty", "log_mfa_age")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_unused_windows_are_pruned(spark):
    text = history.features(make(spark, [(1, 0, "p", "a", "r", "x", 1)]), ("hour_sin", "action_frequency")).select("event_id", "hour_sin")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text
    assert F is not None


def test_bursts_against_a_plain_count(spark):
    import random

    random.seed(1)
    at, rows = 0, []
    for i in range(400):
        at += random.choice([0, 0, 1, 5, 59, 60, 61, 900, 3600, 1799])
        rows.append((i, at, random.choice("pq"), random.choice(["a", "b", "c"]), random.choice("uvwxyz"), "x", random.randint(0, 99)))
    got = features(spark, rows)
    for i, s, p, *_ in rows:
        past = lambda w: [r for r in rows[:i] if r[2] == p and s - r[1] <= w]  # noqa: B023, E731
        hour = past(3600)
        want = (len(past(60)), len(past(900)), len(hour), len({r[4] for r in hour}), len({r[3] for r in hour}))
        assert tuple(got[i][c] for c in ("calls_1min", "calls_15min", "calls_60min", "distinct_resources_60min", "distinct_actions_60min")) == want
        assert got[i]["log_bytes_read_60min"] == pytest.approx(math.log1p(sum(r[6] for r in hour)))


def test_a_hundred_thousand_events_of_one_principal_in_an_hour(spark):
    n = 100_000
    one = make(spark, [(0, 0, "p", "a", "r", "x", 1)]).drop("event_id", "ts", "resource")
    many = spark.range(n).withColumnRenamed("id", "event_id").join(one).withColumn("ts", F.expr("timestamp'2024-01-01 08:00:00' + make_dt_interval(0, 0, 0, event_id * 3599 / 100000)")).withColumn("resource", F.concat(F.lit("r"), (F.col("event_id") % 1000).cast("string")))
    got = history.features(many, history.RECENT).agg(F.max("calls_60min"), F.max("distinct_resources_60min"), F.max("calls_1min"), F.max("log_bytes_read_60min")).first()
    assert got[:2] == (n - 1, 1000) and 1600 < got[2] < 1700 and got[3] == pytest.approx(math.log(n))


def test_only_the_named_features_are_made(spark):
    got = history.features(make(spark, [(1, 0, "p", "a", "r", "x", 1)]), ("hour_sin", "calls_1min"))
    assert {"hour_sin", "calls_1min", "event_id", "label"} <= set(got.columns) and "hour_cos" not in got.columns and not any(c.startswith("_") for c in got.columns)


def crowded(spark, n, seed=4):
    """Events of which half are one principal's; hosts, places, logons, bursts, equal moments."""
    import random

    random.seed(seed)
    at, rows = {"hot": 0, "p": 0, "q": 0}, []
    for i in range(n):
        who = "hot" if i % 2 else random.choice("pq")
        at[who] += random.choice([0, 0, 1, 5, 59, 60, 900, 3600, 1799, 40_000])
        rows.append((i, at[who], who, random.choice(["sts:AssumeRole", "s3:GetObject", "s3:PutObject", "execute-api:Invoke", "other"]), f"r{random.randint(0, 12)}", random.choice(["", "", "a", "b", f"h{i % 40}"]), random.randint(0, 99)))
    return make(spark, rows)


@pytest.mark.parametrize("rows", [7, 60])
def test_a_hot_principal_in_chunks_equals_one_window(spark, rows):
    from tidewatch import model as M

    e = crowded(spark, 600).cache()
    want = {r["event_id"]: r for r in history.features(e).collect()}
    got = {r["event_id"]: r for r in history.spread_features(e, rows=rows).collect()}
    assert set(got) == set(want) and set(got[0].asDict()) == set(want[0].asDict())
    for i, r in want.items():
        for c in M.FEATURES:
            assert got[i][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), (i, c)
    few = {r["event_id"]: r for r in history.spread_features(e, ("hour_sin", "role_tenure_days", "resource_novelty"), rows=rows).collect()}
    assert all(few[i]["resource_novelty"] == pytest.approx(want[i]["resource_novelty"]) for i in want)


def test_without_hot_principals_the_plan_is_the_plain_one(spark):
    e = crowded(spark, 60)
    got = history.spread_features(e)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in got and history.cuts(e.limit(0), 5) is None
    nulls = e.withColumn("principal", F.when(F.col("principal") != "hot", F.col("principal")))
    assert history.spread_features(nulls, rows=10).count() == 60


def test_a_million_events_of_one_principal_spread_over_tasks(spark):
    n, rows = 1_000_000, 50_000
    one = make(spark, [(0, 0, "hot", "s3:GetObject", "r", "x", 1)]).drop("event_id", "ts", "resource", "principal")
    many = spark.range(n).withColumnRenamed("id", "event_id").join(one).withColumn("ts", F.expr("timestamp'2024-01-01 08:00:00' + make_dt_interval(0, 0, 0, event_id * 3)"))
    many = many.withColumn("resource", F.concat(F.lit("r"), (F.col("event_id") % 1000).cast("string"))).withColumn("principal", F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.col("event_id").cast("string")))
    found = history.cuts(many, rows)
    sizes = [r["count"] for r in many.join(found, "principal").groupBy(history.chunk_of(F.unix_micros("ts"))).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1.1 * rows
    got = history.spread_features(many, ("calls_60min", "resource_novelty", "policy_breadth", "role_tenure_days"), rows=rows).where("principal = 'hot'")
    a = got.agg(F.count("*"), F.max("calls_60min"), F.max("role_tenure_days"), F.sum("policy_breadth"), F.sum(F.when(F.col("resource_novelty") == 1, 1).otherwise(0))).first()
    assert a[0] == n // 2 and a[1] == 600 and a[2] == pytest.approx(3 * (n - 2) / 86400) and a[3] == n // 2 - 1 and a[4] == 500


def test_the_windows_tasks_grow_with_the_events(spark, monkeypatch):
    e = crowded(spark, 600).cache()
    monkeypatch.setattr(history, "TASK_ROWS", 50)
    got = history.spread_features(e, ("calls_60min", "resource_novelty"))
    assert got.rdd.getNumPartitions() == 12 and got.count() == 600
    assert history.counts(e.withColumn("principal", F.when(F.col("principal") != "hot", F.col("principal")))) == (600, e.where("principal <> 'hot'").groupBy("principal").count().agg(F.max("count")).first()[0])
    assert history.counts(e.limit(0)) == (0, 0) and history.tasks(spark, 0) == 1


def test_each_key_is_sorted_once(spark):
    text = history.features(make(spark, [(1, 0, "p", "a", "r", "x", 1)]))._jdf.queryExecution().executedPlan().toString()
    # the first event's time, action, resource, asn, host, hour, and the principal's own order
    assert text.count("Sort [") == 7


def test_only_the_kept_columns_go_through_the_windows(spark):
    e = crowded(spark, 200).cache()
    want = {r["event_id"]: r["calls_60min"] for r in history.features(e).collect()}
    for got in (history.features(e, ("calls_60min",), keep=("event_id", "label")), history.spread_features(e, ("calls_60min",), rows=20, keep=("event_id", "label"))):
        assert got.columns == ["event_id", "label", "calls_60min"]
        assert {r["event_id"]: r["calls_60min"] for r in got.collect()} == want
        text = got._jdf.queryExecution().optimizedPlan().toString()
        assert not any("supervisor" in line for line in text.splitlines() if "Window" in line or "Generate" in line)


def test_carried_values_reach_the_chunks_without_joining_the_events(spark):
    e = crowded(spark, 300)
    text = history.spread_features(e, rows=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in text and not any("event_id" in line for line in text.splitlines() if "Join Inner" in line)


def test_tasks_stay_even_when_principals_have_many_events(spark):
    n, users = 750_000, 8  # each has less than a task's events
    one = make(spark, [(0, 0, "p", "s3:GetObject", "r", "x", 1)]).drop("event_id", "ts", "principal")
    many = spark.range(n).withColumnRenamed("id", "event_id").join(one).withColumn("principal", (F.col("event_id") % users).cast("string"))
    many = many.withColumn("ts", F.expr("timestamp'2024-01-01 08:00:00' + make_dt_interval(0, 0, 0, event_id)"))
    got = history.spread_features(many, ("role_tenure_days", "policy_breadth"), keep=("event_id",))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 1.5 * history.TASK_ROWS


def test_smaller_principals_are_cut_into_fewer_chunks(spark):
    who = F.when(F.col("id") < 10_000, "big").when(F.col("id") < 11_500, "mid").otherwise(F.lit("small"))
    e = spark.range(12_000).select(who.alias("principal"), F.timestamp_seconds("id").alias("ts"))
    found = history.cuts(e, 1_000)
    got = e.join(found, "principal").groupBy("principal", history.chunk_of(F.unix_micros("ts")).alias("chunk")).count().collect()
    assert sorted((r["principal"], r["chunk"]) for r in got) == [("big", i) for i in range(10)] + [("mid", 0), ("mid", 1)]
    assert max(r["count"] for r in got) < 1_100
