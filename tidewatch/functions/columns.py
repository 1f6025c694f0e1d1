"""Column functions: classification, trust, bands, geometry, host identity, slugs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import model as M


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits become one dash; blank: unassigned."""
    s = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.btrim(s, F.lit("-")), F.lit("")), F.lit("unassigned"))


def bucket(functional: Column, business: Column, prefix: str = "org-") -> Column:
    return F.concat(F.lit(prefix), slug(F.coalesce(F.nullif(functional, F.lit("")), F.nullif(business, F.lit("")), F.lit("unassigned"))))


def event_type(action: Column, source: Column, resource: Column | None = None) -> Column:
    """sts, s3_read, s3_write, egress or http; a resource under /removable/ is egress too."""
    out = source.isin("device", "file")
    if resource is not None:
        out = out | F.contains(resource, F.lit("/removable/"))
    s3 = action.isin("s3:GetObject", "s3:PutObject")
    return F.when(action.startswith("sts:"), "sts").when(s3 & out, "egress").when(action == "s3:PutObject", "s3_write").when(action == "s3:GetObject", "s3_read").otherwise("http")


def sensitivity(action: Column, resource: Column, egress: Column) -> Column:
    s = M.SENSITIVITY
    return (
        F.when(egress & F.contains(resource, F.lit("removable")), s["removable"])
        .when(action == "execute-api:Invoke", s["external"])
        .when(action.isin(*M.SESSIONS), s["session"])
        .when(resource.startswith("arn:aws:s3:::"), s["bucket"])
        .otherwise(s["default"])
    )


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def effective_risk(r: Column, s: Column, c: Column, *, lam: float = M.LAMBDA, beta: float = M.BETA, literal: bool = False) -> Column:
    """Risk raised by sensitivity, lowered by control credit; in [0, 1]."""
    r, s, c = unit(r), unit(s), unit(c)
    left = F.pow(1 - r, 1 + lam * s)
    return unit(1 - left * (1 - beta * c)) if literal else unit((1 - left) * (1 - beta * c))


def band(r: Column, what: str = "verdict") -> Column:
    """The value of the highest band whose lower bound is at most ``r``."""
    value = lambda b: F.lit(getattr(b, what)).cast("int" if what == "ttl_minutes" else "string")
    out = None
    for b in reversed(M.BANDS[1:]):
        out = F.when(r >= b.lower, value(b)) if out is None else out.when(r >= b.lower, value(b))
    return out.otherwise(value(M.BANDS[0]))


def control_credit(managed: Column, mfa_age: Column, hardware: Column) -> Column:
    fresh = F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), mfa_age) / M.MFA_WINDOW_S)
    full = F.least(F.lit(1.0), 0.6 * fresh + F.when(hardware, 0.4 * fresh).otherwise(0.0))
    return F.when(F.coalesce(managed, F.lit(False)) & mfa_age.isNotNull(), full).otherwise(0.0)


def fuse(e: Column, s: Column, alpha: float = M.ALPHA) -> Column:
    return unit(alpha * e + (1 - alpha) * s)


def _number(hexed: Column, start: int, size: int) -> Column:
    return F.conv(F.substring(hexed, start, size), 16, 10).cast("long")


def host(pc: Column) -> dict[str, Column]:
    """asn, lat, lon of a host name, from its hash; an empty name has none."""
    h = F.sha2(pc, 256)
    none = F.coalesce(pc, F.lit("")) == ""
    return {
        "asn": F.when(none, "AS0").otherwise(F.concat(F.lit("AS"), _number(h, 1, 4).cast("string"))),
        "lat": F.when(none, 0.0).otherwise(_number(h, 5, 6) / F.lit(float(0xFFFFFF)) * 180 - 90),
        "lon": F.when(none, 0.0).otherwise(_number(h, 11, 6) / F.lit(float(0xFFFFFF)) * 360 - 180),
    }


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine; 0 where a place is missing."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.when(h.isNotNull(), 2 * M.EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))).otherwise(0.0)


def glob_regex(pattern: str) -> str:
    """A shell pattern (case kept, * crosses /) as an anchored regex."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))
