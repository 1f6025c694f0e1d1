"""Static entitlement and sensitivity: ordered rules with shell patterns, first match decides.

A policy is a document of bounded size, so its rules become one conditional expression each: no
join with the requests, no shuffle, and the patterns run inside generated code.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.columns import glob_regex

def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def any_glob(value: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | (F.lit(True) if p == "*" else value.rlike("(?s)" + glob_regex(p)))
    return out


def permit(role: Column, action: Column, resource: Column, own_bucket: Column, managed: Column, policy: dict) -> Column:
    """struct(allowed, reason): the first statement that matches decides, a failed condition denies.

    ``policy``: roles -> allow -> statements of actions, resources and a condition; sensitivity -> rules and a default.
    """
    bucket = F.split_part(F.split_part(resource, F.lit(":::"), F.lit(2)), F.lit("/"), F.lit(1))
    result = lambda ok, why: F.struct(F.lit(ok).alias("allowed"), why.alias("reason"))
    none = result(False, F.concat(F.lit("nothing lets "), role, F.lit(" do "), action, F.lit(" with "), resource))
    out = result(False, F.concat(F.lit("the policy has no role "), role))
    for name, body in policy["roles"].items():
        inner = none
        for s in reversed(body.get("allow", [])):
            cond, verdict = s.get("condition", {}), result(True, F.concat(F.lit("granted to "), role))
            if cond.get("require_managed_device"):
                verdict = F.when(F.coalesce(managed, F.lit(False)), verdict).otherwise(result(False, F.lit("only from a managed device")))
            if cond.get("own_unit_bucket"):
                own = F.coalesce(own_bucket, F.lit(""))
                verdict = F.when((own != "") & (bucket == own), verdict).otherwise(result(False, F.concat(bucket, F.lit(" is outside the unit's own "), own)))
            inner = F.when(any_glob(action, s["actions"]) & any_glob(resource, s["resources"]), verdict).otherwise(inner)
        out = F.when(role == name, inner).otherwise(out)
    return out


def sensitivity(resource: Column, policy: dict) -> Column:
    out = F.lit(float(policy["sensitivity"].get("default", 0.5)))
    for r in reversed(policy["sensitivity"].get("rules", [])):
        out = F.when(any_glob(resource, [r["pattern"]]), float(r["value"])).otherwise(out)
    return out
