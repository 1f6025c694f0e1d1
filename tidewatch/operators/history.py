"""Each event against its principal's own history, strictly before it in (ts, event_id) order.

Decayed counts are running sums of 2^((t - t0) / half-life), t0 being the principal's first event:
the factor of the present cancels in every frequency, so no state is folded. All windows partition
by the principal first, so that one exchange serves them all; the finer ones sort within it.

What the last minute, quarter and hour hold is a running sum too: an event adds itself, and a row
of its own takes it away when it has left the window. So a burst costs what its events cost, not
their square. A resource counts in the hour while its last event does: an event takes its
predecessor's place, or the predecessor goes by itself.

A principal with very many events is cut into chunks of time (``spread_features``). Every window
above runs within a chunk, and starts from what the chunks before it left behind: sums, the last
place and logon, the keys seen and when, which are small tables of one row a chunk or a chunk's
key. The results are those of one window over the whole principal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewatch import model as M
from tidewatch.functions import columns as C
from tidewatch.session import materialise

ORDER = ("us", "_kind", "event_id")
MINUTE, QUARTER, HOUR = 60_000_000, 900_000_000, 3_600_000_000
#: Features that look at the last minute, quarter or hour.
RECENT = ("calls_1min", "calls_15min", "calls_60min", "log_bytes_read_60min", "distinct_resources_60min", "distinct_actions_60min")
#: Events of a principal that stay together; a principal with more is cut into chunks, at most MOST_CHUNKS. A sixth of a
#: task's events, as principals and chunks go to tasks by hash: a task that gets some more of them is not much larger.
CHUNK_ROWS, MOST_CHUNKS = 25_000, 512
#: Events that a task of the windows gets, on average; all windows of a task together hold about 10 KB an event. Smaller
#: tasks take longer in all: each compiles the windows' code again.
TASK_ROWS = 150_000
WHOLE, CHUNKED = ("principal",), ("principal", "_chunk")
_DELTAS = ("_n1", "_n15", "_n60", "_bytes", "_resources", "_actions")
#: Columns that the windows look at.
_INPUTS = ("principal", "event_id", "ts", "us", "w", "action", "resource", "asn", "pc", "lat", "lon", "bytes_read")
#: What a feature needs of a key's own windows: is its value new, its sum, its neighbours in time, the hour's sum.
_NEEDS = {
    "first_time_action": ("action", "new"), "policy_breadth": ("action", "new"), "action_frequency": ("action", "sum"), "distinct_actions_60min": ("action", "near"),
    "first_time_resource": ("resource", "new"), "resource_novelty": ("resource", "sum"), "distinct_resources_60min": ("resource", "near"),
    "asn_novelty": ("asn", "new"), "host_novelty": ("pc", "new"), "device_fingerprint_match": ("pc", "new"), "modal_hour_deviation": ("_hour", "hours"),
}


def own(*keys: str, by: tuple[str, ...] = WHOLE) -> WindowSpec:
    return Window.partitionBy(*by, *keys).orderBy(*ORDER)


def before(*keys: str, by: tuple[str, ...] = WHOLE) -> WindowSpec:
    return own(*keys, by=by).rowsBetween(Window.unboundedPreceding, -1)


def weighted(events: DataFrame, first: Column | None = None) -> DataFrame:
    """Adds us (microseconds), _kind (0: an event) and w (decay weight from the principal's ``first`` event on)."""
    e = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_kind", F.lit(0))
    age = F.col("us") - (F.min("us").over(Window.partitionBy("principal")) if first is None else first)
    return e.withColumn("w", F.pow(F.lit(2.0), age / (M.HALF_LIFE_DAYS * 86400e6)))


def _keys(names: tuple[str, ...]) -> dict[str, set[str]]:
    """Keys within a principal that the features ``names`` need, and what of them."""
    out: dict[str, set[str]] = {}
    for name, (key, what) in _NEEDS.items():
        if name in names:
            out.setdefault(key, set()).add(what)
    return out


def entropy(total: Column, parts: list[Column]) -> Column:
    terms = [F.when((p > 0) & (total > 0), -(p / total) * F.ln(p / total)).otherwise(0.0) for p in parts]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _recent_rows(e: DataFrame, by: tuple[str, ...], kept: list[str]) -> DataFrame:
    """Each event as four rows, itself (with the columns ``kept``) and one at the end of each window, with what each adds to the counts.

    Those at a window's end sort after the events of their moment, as windows are closed; they may belong to a later chunk.
    """
    us, none = F.col("us"), F.lit(0).cast("long")
    size = F.coalesce(F.col("bytes_read"), none) if "bytes_read" in e.columns else none
    has = lambda k: f"_last_{k}" in e.columns
    stays = lambda k: F.when(us - F.col(f"_last_{k}") <= HOUR, 0).otherwise(1).cast("long") if has(k) else none
    goes = lambda k: F.when(F.col(f"_next_{k}") - us <= HOUR, 0).otherwise(-1).cast("long") if has(k) else none
    whole = F.struct(*[F.col(f"`{c}`") for c in kept])

    def row(at: Column, kind: int, deltas: tuple, event: Column, chunk: str) -> Column:
        where = [F.col(chunk).alias("_chunk")] if by == CHUNKED else []
        where.append((F.lit(None) if kind else F.col("event_id")).cast(dict(e.dtypes)["event_id"]).alias("event_id"))
        return F.struct(*where, at.alias("us"), F.lit(kind).alias("_kind"), *[(d if isinstance(d, Column) else F.lit(d)).cast("long").alias(f"{n}_d") for n, d in zip(_DELTAS, deltas, strict=True)], event.alias("_event"))

    gone = F.when(F.lit(False), whole)
    rows = F.array(
        row(us, 0, (1, 1, 1, size, stays("resource"), stays("action")), whole, "_chunk"), row(us + MINUTE, 1, (-1, 0, 0, 0, 0, 0), gone, "_minute_chunk"),
        row(us + QUARTER, 1, (0, -1, 0, 0, 0, 0), gone, "_quarter_chunk"), row(us + HOUR, 1, (0, 0, -1, -size, goes("resource"), goes("action")), gone, "_hour_chunk"),
    )
    return e.select("principal", F.inline(rows))


def features(events: DataFrame, names: tuple[str, ...] = M.FEATURES, *, compat: bool = False, actions: tuple[str, ...] = M.ACTIONS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The events with the features ``names`` (all 34) as columns; unused ones and their windows are pruned away.

    ``keep``: the events' own columns to return beside them (all); what is not asked for goes through no window.
    ``compat`` keeps two quirks of older deployments: role words match as substrings, and every
    bucket is foreign to a unit whose name is not a slug.
    """
    e = _prepared(weighted(events), names, compat, keep)
    return _described(_keyed(e, names, WHOLE), names, actions, keep, WHOLE)


def _prepared(e: DataFrame, names: tuple[str, ...], compat: bool, keep: tuple[str, ...] | None) -> DataFrame:
    """Weighted events with the host's columns and the features that need no history; these are made first, so that no window carries what they come from."""
    for name, col in C.host(F.col("pc")).items():
        e = e.withColumn(name, col)
    hour = F.hour("ts")
    role = F.lower(F.coalesce("role", F.lit("")))
    kind = role.rlike("admin|it|director") if compat else role.rlike("admin|director|(^|[^a-z])it([^a-z]|$)")
    s3 = F.col("resource").startswith("arn:aws:s3:::")
    bucket = F.split_part(F.split_part("resource", F.lit(":::"), F.lit(2)), F.lit("/"), F.lit(1))
    foreign = (F.concat(F.lit("org-"), F.regexp_replace(F.lower("functional_unit"), " ", "-")) != bucket) if compat else (bucket != F.col("unit_bucket"))
    out = {
        "principal_type": kind,
        "cross_account_depth": sum(((F.coalesce(c, F.lit("")) != "").cast("double") for c in ("business_unit", "functional_unit", "department", "team")), F.lit(0.0)),
        "is_supervisor": F.col("known") & (F.trim(F.coalesce("supervisor", F.lit(""))) == ""),
        "is_session_action": F.col("action").isin(*M.SESSIONS),
        "is_egress_action": F.col("egress"),
        "resource_sensitivity": C.sensitivity(F.col("action"), F.col("resource"), F.col("egress")),
        "cross_account_flag": F.col("known") & s3 & foreign,
        "arn_prefix_depth": F.length("resource") - F.length(F.replace("resource", F.lit("/"), F.lit(""))),
    }
    wanted = {name: col.cast("double") for name, col in out.items() if name in names}
    kept = [c for c in e.columns if c not in wanted and (c not in M.FEATURES or c in names) and (keep is None or c in keep or c in _INPUTS or c.startswith("_"))]
    return e.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(name) for name, c in wanted.items()], hour.alias("_hour"))


def _keyed(e: DataFrame, names: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """Adds what the windows within a key say: whether its value is new, its sum, when it came before and comes next, and the hour's sum.

    One sort a key. Chunks hold rows of carried values beside the events, before them: a row's _what names its key.
    """
    carried = by == CHUNKED
    event = F.col("_kind") == 0
    mine = lambda k, own_, left: F.when(event, own_).when(F.col("_what") == k, F.col(left)) if carried else own_
    w, us = F.col("w"), F.col("us")
    for k, wanted in _keys(names).items():
        spec, new = own(k, by=by), []
        if "hours" in wanted:
            # an hour's sum never falls, so the largest of all hours' sums is the largest that any event left behind
            new.append(F.sum(mine(k, w, "w")).over(spec.rowsBetween(Window.unboundedPreceding, 0)).alias("_hour_sum"))
        if "new" in wanted:
            first = F.count(mine(k, F.lit(1), "_seen")).over(before(k, by=by)) == 0 if carried else F.row_number().over(spec) == 1
            new.append(first.cast("double").alias(f"_first_{k}"))
        if "sum" in wanted:
            new.append(F.coalesce(F.sum(mine(k, w, "w")).over(before(k, by=by)), F.lit(0.0)).alias(f"_sum_{k}"))
        if "near" in wanted:
            last = F.last(mine(k, us, "_was"), ignorenulls=True).over(before(k, by=by)) if carried else F.lag("us").over(spec)
            next_ = F.lead("us").over(spec)
            if carried:
                left = F.max(F.when(F.col("_what") == k, F.col("_next"))).over(spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                next_ = F.coalesce(next_, left)
            new += [last.alias(f"_last_{k}"), next_.alias(f"_next_{k}")]
        e = e.select("*", *new)
    if "_first_pc" in e.columns:
        e = e.withColumn("_first_pc", F.when(F.col("pc") == "", 1.0).otherwise(F.col("_first_pc")))
    return e.where(event).drop("_what", "_seen", "_was", "_next") if carried else e


def _described(e: DataFrame, names: tuple[str, ...], actions: tuple[str, ...], keep: tuple[str, ...] | None, by: tuple[str, ...], chunk: DataFrame | None = None, parts: int = 0) -> DataFrame:
    """The features of keyed events within each group of ``by``. Chunks start from the rows of ``chunk``, which go before their events."""
    carried = by == CHUNKED
    left = lambda name: F.col(f"_carried.{name}")
    none = F.lit(0).cast("long")
    after_ = ("principal", "event_id", "us", "_kind", "_chunk")
    own_ = [c for c in e.columns if c not in after_ and not c.startswith("_") and (keep is None or c in keep or c in (*M.FEATURES, "ts", "action", "lat", "lon", "w"))]
    kept = own_ + [c for c in e.columns if c.startswith(("_first_", "_sum_")) or c in ("_hour", "_hour_sum")]
    recent = bool(set(names) & set(RECENT))
    if recent:
        e = _recent_rows(e, by, kept)
        if carried:
            ends = e.groupBy(*by).agg(*[F.sum(f"{n}_d").alias(n) for n in _DELTAS])
            starts = ends.select(*by, *[F.coalesce(F.sum(n).over(_ahead()), none).alias(f"{n}_d") for n in _DELTAS])
            chunk = chunk.join(starts, list(by), "left")
    if carried:
        e = e.unionByName(chunk, allowMissingColumns=True).repartition(parts, *by)
    if recent:
        e = e.select("*", *[F.coalesce(F.sum(f"{n}_d").over(before(by=by)), none).alias(n) for n in _DELTAS]).where("_kind <= 0")
        e = e.select(*by, "event_id", "us", "_kind", *_DELTAS, *(["_carried"] if carried else []), *[F.col(f"_event.`{c}`").alias(c) for c in kept])
    # no sort from here on: the rows are in the order of these windows
    within = before(by=by)
    decayed = lambda value: F.coalesce(F.sum(value).over(within), F.lit(0.0))
    logon = F.when(F.col("action") == "sts:AssumeRole", F.col("us"))
    raw = {
        "_total": decayed(F.col("w")),
        "_reads": decayed(F.when(F.col("action").isin(*M.READS), F.col("w")).otherwise(0.0)),
        **{f"_part_{i}": decayed(F.when(F.col("action") == a, F.col("w")).otherwise(0.0)) for i, a in enumerate(actions)},
        "_prev_us": F.lag("us").over(own(by=by)),
        "_first_us": F.min("us").over(within),
        "_prev_lat": F.lag("lat").over(own(by=by)),
        "_prev_lon": F.lag("lon").over(own(by=by)),
        "_logon_us": F.last(logon, ignorenulls=True).over(within),
    }
    if "_hour_sum" in e.columns:
        raw["_modal"] = F.max(F.when(F.col("_kind") == 0, F.struct("_hour_sum", (-F.col("_hour")).alias("h")))).over(within)
    if "_first_action" in e.columns:
        raw["_breadth"] = F.coalesce(F.sum("_first_action").over(within), F.lit(0.0))
    if carried:
        raw["_carried"] = F.first("_carried").over(own(by=by).rowsBetween(Window.unboundedPreceding, 0))
    e = e.select(*[c for c in e.columns if c != "_carried"], *[c.alias(name) for name, c in raw.items()])
    if carried:
        e = e.where("_kind = 0")
    plus = lambda name, of: left(of) + F.col(name) if carried else F.col(name)
    unless = lambda name, of: F.coalesce(name, left(of)) if carried else F.col(name)
    # of the event before, whose value may be null
    lagged = lambda name: F.when(F.col("_prev_us").isNull(), left(name)).otherwise(F.col(f"_prev_{name}")) if carried else F.col(f"_prev_{name}")
    total, us, n = plus("_total", "total"), F.col("us"), lambda c: F.col(c).cast("double")
    shares = [left("parts")[i] + F.col(f"_part_{i}") if carried else F.col(f"_part_{i}") for i in range(len(actions))]
    first_us = F.coalesce(left("first"), "_first_us") if carried else F.col("_first_us")

    def deviation() -> Column:
        modal = F.greatest(left("modal"), "_modal") if carried else F.col("_modal")
        apart = F.abs(F.col("_hour") + modal.h)
        return F.when(total > 0, F.least(apart, 24 - apart) / 12.0).otherwise(0.0)

    angle = 2 * math.pi * (F.hour("ts") + F.minute("ts") / 60.0) / 24.0
    day = 2 * math.pi * F.weekday("ts") / 7.0
    out = {
        "hour_sin": lambda: F.sin(angle),
        "hour_cos": lambda: F.cos(angle),
        "dow_sin": lambda: F.sin(day),
        "dow_cos": lambda: F.cos(day),
        "role_tenure_days": lambda: F.coalesce((us - first_us) / 86400e6, F.lit(0.0)),
        "policy_breadth": lambda: plus("_breadth", "breadth"),
        "modal_hour_deviation": deviation,
        "log_inter_request_gap": lambda: F.coalesce(F.log1p(F.greatest(F.lit(0.0), (us - unless("_prev_us", "us")) / 1e6)), F.lit(0.0)),
        "action_frequency": lambda: C.ratio(F.col("_sum_action"), total),
        "read_write_ratio": lambda: C.ratio(plus("_reads", "reads"), total, 0.5),
        "first_time_action": lambda: F.col("_first_action"),
        "action_class_entropy": lambda: entropy(total, shares),
        "log_action_history": lambda: F.log1p(total / F.col("w")),
        "resource_novelty": lambda: 1 - C.ratio(F.col("_sum_resource"), total),
        "first_time_resource": lambda: F.col("_first_resource"),
        "calls_1min": lambda: n("_n1"),
        "calls_15min": lambda: n("_n15"),
        "calls_60min": lambda: n("_n60"),
        "log_bytes_read_60min": lambda: F.log1p(n("_bytes")),
        "distinct_resources_60min": lambda: n("_resources"),
        "distinct_actions_60min": lambda: n("_actions"),
        "asn_novelty": lambda: F.col("_first_asn"),
        "geodesic_distance_km": lambda: C.geodesic_km(lagged("lat"), lagged("lon"), F.col("lat"), F.col("lon")),
        "device_fingerprint_match": lambda: 1 - F.col("_first_pc"),
        "log_mfa_age": lambda: F.coalesce(F.log1p((us - unless("_logon_us", "logon")) / 1e6), F.lit(0.0)),
        "host_novelty": lambda: F.col("_first_pc"),
    }
    wanted = {name: col().cast("double") for name, col in out.items() if name in names}
    base = ["principal", "event_id", "us", *own_] if keep is None else [c for c in ("principal", "event_id", "us", *own_) if c in keep or c in names]
    return e.select(*[F.col(f"`{c}`") for c in base if c not in wanted], *[c.alias(name) for name, c in wanted.items()])


# --- a principal's history in chunks ---------------------------------------------------------


def _ahead(*keys: str) -> WindowSpec:
    """The earlier chunks; there are at most MOST_CHUNKS of a principal (and key)."""
    return Window.partitionBy("principal", *keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def chunk_of(us: Column) -> Column:
    return F.size(F.filter("_cuts", lambda x: x <= us))


def counts(events: DataFrame) -> tuple[int, int]:
    """The number of events, and of those of the principal with most."""
    n = events.groupBy("principal").agg(F.count("*").alias("_n"))
    all_, most = n.agg(F.sum("_n"), F.max(F.when(F.col("principal").isNotNull(), F.col("_n")))).first()
    return all_ or 0, most or 0


def tasks(spark: SparkSession, n: int) -> int:
    """Into how many tasks the windows over ``n`` events go: their memory stays the same as the events grow."""
    return max(1, -(-n // TASK_ROWS), min(spark.sparkContext.defaultParallelism, n // 25_000))


def cuts(events: DataFrame, rows: int, counted: DataFrame | None = None, most: int | None = None) -> DataFrame | None:
    """principal, _first, _cuts of the principals with more than ``rows`` events; None where there is none.

    The cuts are times that part a principal's events about evenly, into pieces of up to ``rows``; of the largest one's
    shares a smaller principal takes every second, third and so on. ``counted``: rows with the same principals and
    times as ``events`` that are cheaper to read; ``most``: the events of the largest, if known.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    counted = events if counted is None else counted
    most = counts(counted)[1] if most is None else most
    if most <= rows:
        return None
    many = counted.where("principal is not null").groupBy("principal").agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    chunks = min(MOST_CHUNKS, -(-most // rows))
    at = F.percentile_approx(us, [i / chunks for i in range(1, chunks)], 20 * MOST_CHUNKS)
    found = counted.join(many, "principal", "left_semi").groupBy("principal").agg(F.min(us).alias("_first"), at.alias("_cuts"), F.count("*").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(chunks * rows) / F.col("_n")))
    return materialise(found.select("principal", "_first", F.filter("_cuts", lambda x, i: (i + 1) % step == 0).alias("_cuts")), "cuts")


def carries(e: DataFrame, names: tuple[str, ...], actions: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """What earlier chunks leave to each chunk, and to each chunk's value of each key, as rows that go before the chunk's events."""
    keyed, keys = None, list(_keys(names))
    if keys:
        # sums and times of those keys alone that need them
        only = lambda k, c, *what: (F.col(c) if set(what) & _keys(names)[k] else F.lit(None).cast(dict(e.dtypes)[c])).alias(c)
        values = F.inline(F.array(*[F.struct(F.lit(k).alias("_what"), F.col(k).cast("string").alias("_value"), only(k, "w", "sum", "hours"), only(k, "us", "near")) for k in keys]))
        each = e.select("principal", "_chunk", values).groupBy("principal", "_what", "_value", "_chunk")
        each = each.agg(F.sum("w").alias("s"), F.max("us").alias("last"), F.min("us").alias("first"))
        order = Window.partitionBy("principal", "_what", "_value").orderBy("_chunk")
        kinds = dict(e.dtypes)
        keyed = each.select(
            "principal", "_chunk", "_what", "_value", F.sum("s").over(_ahead("_what", "_value")).alias("w"), F.lag(F.lit(1)).over(order).alias("_seen"), F.lag("last").over(order).alias("_was"), F.lead("first").over(order).alias("_next"),
        ).where("_seen is not null or _next is not null")
        of = lambda k: F.when(F.col("_what") == k, F.col("_value")).cast(kinds[k]).alias(k)
        keyed = keyed.select("principal", "_chunk", F.lit(-1).alias("_kind"), "w", "_what", "_seen", "_was", "_next", *[of(k) for k in keys])
    when = lambda on: F.sum(F.when(on, F.col("w")).otherwise(0.0))
    hours, parts = [f"_h{h}" for h in range(24)], [f"_p{i}" for i in range(len(actions))]
    one = e.groupBy("principal", "_chunk").agg(
        F.sum("w").alias("total"), when(F.col("action").isin(*M.READS)).alias("reads"), *[when(F.col("action") == a).alias(p) for a, p in zip(actions, parts, strict=True)],
        *[when(F.col("_hour") == h).alias(c) for h, c in enumerate(hours)], F.max_by(F.struct("us", "lat", "lon"), F.struct("us", "event_id")).alias("last"),
        F.max(F.when(F.col("action") == "sts:AssumeRole", F.col("us"))).alias("logon"), F.min("us").alias("first"),
    )
    new = e.groupBy("principal", "action").agg(F.min("_chunk").alias("_chunk")).groupBy("principal", "_chunk").agg(F.count("*").alias("new"))
    one = one.join(new, ["principal", "_chunk"], "left")
    total = lambda c: F.coalesce(F.sum(c).over(_ahead()), F.lit(0.0))
    last = F.last("last").over(_ahead())
    got = one.select(
        "principal", "_chunk", total("total").alias("total"), total("reads").alias("reads"), F.array(*map(total, parts)).alias("parts"), F.array(*map(total, hours)).alias("hours"),
        last.us.alias("us"), last.lat.alias("lat"), last.lon.alias("lon"), F.max("logon").over(_ahead()).alias("logon"), F.min("first").over(_ahead()).alias("first"), total("new").alias("breadth"),
    )
    # of the hours that have been seen the one of the greatest sum, the earlier one of two
    modal = F.array_max(F.filter(F.transform("hours", lambda x, i: F.struct(x.alias("_hour_sum"), (-i).alias("h"))), lambda x: x["_hour_sum"] > 0))
    whole = F.struct("total", "reads", "parts", "us", "lat", "lon", "logon", "first", "breadth", modal.alias("modal"))
    return got.select("principal", "_chunk", F.lit(-1).alias("_kind"), whole.alias("_carried")), keyed


def spread_features(events: DataFrame, names: tuple[str, ...] = M.FEATURES, *, compat: bool = False, actions: tuple[str, ...] = M.ACTIONS, rows: int = CHUNK_ROWS, counted: DataFrame | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``features``, with the principals of more than ``rows`` events cut into chunks that are worked on apart.

    One pass counts the events (or the rows of ``counted``, which has the same principals and times) by principal; the
    windows' exchange goes to as many tasks as that number asks for, to twice as many with principals in chunks. Without such principals the plan is that of
    ``features``. A null principal is not cut. Carried values go into the chunks' exchange as rows, so no join shuffles the events.
    """
    n, most = counts(events if counted is None else counted)
    parts = tasks(events.sparkSession, n)
    found = cuts(events, rows, counted, most)
    how = {"compat": compat, "actions": actions, "keep": keep}
    if found is None:
        return features(events.repartition(parts, "principal"), names, **how)
    parts = tasks(events.sparkSession, 2 * n)  # units are large here, and a task may get more of them than others do
    rest = events.join(found, "principal", "left_anti").repartition(parts, "principal")
    us = F.col("us")
    hot = weighted(events.join(found, "principal"), F.col("_first")).drop("_first")
    hot = hot.withColumns({"_chunk": chunk_of(us), "_minute_chunk": chunk_of(us + MINUTE), "_quarter_chunk": chunk_of(us + QUARTER), "_hour_chunk": chunk_of(us + HOUR)}).drop("_cuts")
    hot = materialise(_prepared(hot, names, compat, keep), "chunks")
    chunk, carried = carries(hot, names, actions)
    if carried is not None:
        both = hot.unionByName(carried, allowMissingColumns=True).repartition(parts, *CHUNKED)
        hot = _keyed(both, names, CHUNKED)
        if set(names) & set(RECENT):
            hot = materialise(hot, "chunks-keyed")  # read for the counts that cross chunks, and for the events
    got = _described(hot, names, actions, keep, CHUNKED, chunk, parts)
    return features(rest, names, **how).unionByName(got)


def window_counts(events: DataFrame, seconds: dict[str, int]) -> DataFrame:
    """event_id, principal and, for each named width, how many earlier events of the principal it holds."""
    e = events.select("event_id", "principal", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    one = lambda at, kind, name: F.struct(at.alias("us"), F.lit(kind).alias("_kind"), *[F.lit(1 if kind == 0 else -int(name == x)).cast("long").alias(f"_d_{i}") for i, x in enumerate(seconds)])
    rows = [one(F.col("us"), 0, "")] + [one(F.col("us") + width * 1_000_000, 1, name) for name, width in seconds.items()]
    long = e.select("event_id", "principal", F.inline(F.array(*rows)))
    counted = long.select("*", *[F.coalesce(F.sum(f"_d_{i}").over(before()), F.lit(0)).cast("long").alias(name) for i, name in enumerate(seconds)])
    return counted.where("_kind = 0").select("event_id", "principal", *seconds)
