import math

import pytest
from pyspark.sql import functions as F

from tidewatch import model as M
from tidewatch.functions import columns as C
from tidewatch.operators import policy
from tidewatch.plans.catalog import POLICY


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


@pytest.mark.parametrize(("r", "verdict"), [(0.0, "ALLOW"), (0.3999, "ALLOW"), (0.40, "ALLOW_OBSERVE"), (0.6499, "ALLOW_OBSERVE"), (0.65, "STEPUP"), (0.8499, "STEPUP"), (0.85, "DENY"), (1.0, "DENY")])
def test_band_edges(spark, r, verdict):
    assert one(spark, v=C.band(F.lit(r)))["v"] == verdict


def test_trust(spark):
    e = lambda *x, **k: C.effective_risk(*map(F.lit, x), **k)
    got = one(spark, zero=e(0.0, 1.0, 0.5), mid=e(0.5, 1.0, 0.0), credit=e(0.5, 0.0, 1.0), literal=e(0.0, 0.5, 1.0, literal=True))
    assert got == pytest.approx({"zero": 0.0, "mid": 1 - 0.5**2.5, "credit": 0.375, "literal": 0.25})


def test_trust_rises_with_risk_and_sensitivity(spark):
    grid = [i / 10 for i in range(11)]
    rows = spark.createDataFrame([(r, s) for r in grid for s in grid], "r double, s double").withColumn("e", C.effective_risk(F.col("r"), F.col("s"), F.lit(0.0))).collect()
    e = {(x["r"], x["s"]): x["e"] for x in rows}
    assert all(e[a, s] <= e[b, s] + 1e-12 and e[s, a] <= e[s, b] + 1e-12 for a, b in zip(grid, grid[1:]) for s in grid)


def test_credit_needs_a_managed_device_and_a_known_age(spark):
    c = lambda m, a, h: C.control_credit(F.lit(m), F.lit(a).cast("double"), F.lit(h))
    got = one(spark, fresh=c(True, 0.0, True), soft=c(True, 14400.0, False), unmanaged=c(False, 0.0, True), unknown=c(True, None, True), old=c(True, 1e6, True))
    assert got == pytest.approx({"fresh": 1.0, "soft": 0.3, "unmanaged": 0.0, "unknown": 0.0, "old": 0.0})


def test_slug_and_bucket(spark):
    got = one(spark, a=C.slug(F.lit("1 - Research")), b=C.slug(F.lit("  ")), c=C.bucket(F.lit(""), F.lit("Sales & Co")), d=C.bucket(F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert got == {"a": "1-research", "b": "unassigned", "c": "org-sales-co", "d": "org-unassigned"}


def test_host_identity_and_distance(spark):
    h = C.host(F.lit("PC-1"))
    got = one(spark, **h, none=C.host(F.lit(""))["asn"], same=C.geodesic_km(h["lat"], h["lon"], h["lat"], h["lon"]), gone=C.geodesic_km(F.lit(None).cast("double"), h["lon"], h["lat"], h["lon"]))
    assert got["none"] == "AS0" and got["same"] == 0 and got["gone"] == 0
    assert got["asn"].startswith("AS") and -90 <= got["lat"] <= 90 and -180 <= got["lon"] <= 180
    quarter = one(spark, d=C.geodesic_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))["d"]
    assert quarter == pytest.approx(M.EARTH_KM * math.pi / 2)


def test_event_types(spark):
    t = lambda a, s, r="": C.event_type(F.lit(a), F.lit(s), F.lit(r))
    got = one(spark, a=t("sts:SessionEnd", "logon"), b=t("s3:GetObject", "file"), c=t("s3:PutObject", "portal"), d=t("s3:GetObject", "pdp"), e=t("s3:GetObject", "pdp", "x/removable/y"), f=t("execute-api:Invoke", "http"))
    assert got == {"a": "sts", "b": "egress", "c": "s3_write", "d": "s3_read", "e": "egress", "f": "http"}


def test_policy_first_match_decides(spark):
    doc = {"roles": {"r": {"allow": [{"actions": ["s3:*"], "resources": ["a/*"], "condition": {"require_managed_device": True}}, {"actions": ["*"], "resources": ["*"]}]}}}
    p = lambda role, action, res, managed: policy.permit(F.lit(role), F.lit(action), F.lit(res), F.lit("u"), F.lit(managed), doc)
    got = one(spark, denied=p("r", "s3:Get", "a/b/c", False), ok=p("r", "s3:Get", "a/b/c", True), later=p("r", "sts:X", "z", False), unknown=p("q", "x", "y", True))
    assert got["denied"] == (False, "only from a managed device") and got["ok"][0] and got["later"][0] and got["unknown"] == (False, "the policy has no role q")


def test_policy_condition_on_the_own_bucket(spark):
    p = lambda res, own: policy.permit(F.lit("staff"), F.lit("s3:GetObject"), F.lit(res), F.lit(own).cast("string"), F.lit(False), POLICY)
    got = one(spark, mine=p("arn:aws:s3:::org-a/docs/x", "org-a"), other=p("arn:aws:s3:::org-b/docs/x", "org-a"), none=p("arn:aws:s3:::org-b/docs/x", None))
    assert [got[k][0] for k in ("mine", "other", "none")] == [True, False, False]
    s = one(spark, a=policy.sensitivity(F.lit("arn:aws:s3:::b/removable/f1x"), POLICY), b=policy.sensitivity(F.lit("zzz"), POLICY))
    assert s == {"a": 0.95, "b": 0.35}
