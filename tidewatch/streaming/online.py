"""The online decision path: per-principal state with verdict feedback, as Structured Streaming.

A request is described against the state, scored, turned into a verdict and recorded in the
principal's chain; unless the verdict is DENY, the request is then folded into the state. So the
state depends on the scores, which no window expression can say: it is a stateful operator keyed
by principal. Micro-batches are folded in (ts, event_id) order.

The state is typed and kept in parts: a value with what has a fixed size, maps from actions,
resources, networks and hosts, and a list of the last hour's requests. Counts are decayed when they
are looked up, so a batch reads and writes only the keys that its requests touch. While a principal has
few keys they are one list instead, read and written at once: each key of a map is a call of its own. A burst
costs what its requests cost: the last hour is kept in order, with counts beside it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import model as M
from tidewatch.operators.ledger import record_hash

try:
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
except ImportError:  # it needs protobuf; all but ``online`` works without
    StatefulProcessor = StatefulProcessorHandle = object

HOUR_S = 3600
#: Keys up to which a principal's maps are kept as one list.
FEW = 256
REQUEST = "event_id long, ts timestamp, principal string, action string, resource string, bytes_read long, sensitivity double, credit double, pc string, asn string, lat double, lon double, hour int, managed boolean, mfa_age double, context map<string,double>"
#: Features that a request has without any history: the batch side computes them, ``context`` carries them.
CONTEXT = ("principal_type", "cross_account_depth", "is_supervisor", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_session_action", "is_egress_action", "cross_account_flag", "arn_prefix_depth")
DECISION = "event_id long, ts timestamp, principal string, action_frequency double, resource_novelty double, calls_60min double, log_inter_request_gap double, r double, r_eff double, verdict string, seq long, prevHash string, hash string, features array<double>"

Score = Callable[[dict], float]


def history_score(f: dict) -> float:
    """A stand-in score from history alone."""
    return min(1.0, 0.5 * f["resource_novelty"] + 0.5 * (1 - f["action_frequency"]))


def verdict_of(r: float) -> str:
    return next(b.verdict for b in reversed(M.BANDS) if r >= b.lower)


def effective(r: float, s: float, c: float) -> float:
    clip = lambda x: min(1.0, max(0.0, x))
    r, s, c = clip(r), clip(s), clip(c)
    return clip((1 - (1 - r) ** (1 + M.LAMBDA * s)) * (1 - M.BETA * c))


class Kept:
    """A map in memory; a stream's maps look keys up in its state instead."""

    def __init__(self, known: dict | None = None) -> None:
        self.known: dict = known or {}

    def find(self, key):
        return None

    def get(self, key):
        if key not in self.known:
            self.known[key] = self.find(key)
        return self.known[key]

    def put(self, key, value: tuple) -> None:
        self.known[key] = value


class Recent:
    """The requests of the last hour in order of time, with their bytes and how often each resource and action occurs."""

    def __init__(self, rows: list[tuple] = ()) -> None:
        self.rows: list[tuple] = []  # time, resource, action, bytes
        self.start, self.bytes, self.resources, self.actions = 0, 0, Counter(), Counter()
        for row in rows:
            self.add(row)

    def add(self, row: tuple) -> None:
        insort(self.rows, row, lo=self.start, key=lambda x: x[0])
        self.bytes += row[3]
        self.resources[row[1]] += 1
        self.actions[row[2]] += 1

    def forget(self, before: float) -> None:
        """Requests of earlier times than ``before`` go."""
        while self.start < len(self.rows) and self.rows[self.start][0] < before:
            _, resource, action, size = self.rows[self.start]
            self.start += 1
            self.bytes -= size
            for counts, key in ((self.resources, resource), (self.actions, action)):
                counts[key] -= 1
                if not counts[key]:
                    del counts[key]
        if self.start > 1_000 and 2 * self.start > len(self.rows):
            del self.rows[: self.start]
            self.start = 0

    def since(self, time: float) -> float:
        return float(len(self.rows) - bisect_left(self.rows, time, lo=self.start, key=lambda x: x[0]))

    def left(self) -> list[tuple]:
        return self.rows[self.start :]


FIXED = "at double, first double, seen double, logon double, lat double, lon double, total double, reads double, hours array<double>, n_actions long, seq long, head string, cut double"


class Profile:
    """One principal's decayed counts, first times, recent requests and chain head.

    ``at`` is the time that total, reads and hours are decayed to; a map's counts have their own.
    """

    def __init__(self, fixed: tuple | None = None, recent: list[tuple] = (), maps: dict[str, Kept] | None = None) -> None:
        f = fixed or (None,) * 6 + (0.0, 0.0, [0.0] * 24, 0, 0, M.GENESIS, None)
        self.at, self.first, self.seen, self.logon, lat, lon, self.total, self.reads, hours, self.n_actions, self.seq, self.head, self.cut = f
        self.place = None if lat is None else [lat, lon]
        self.hours = list(hours)
        self.maps = maps or {k: Kept() for k in ("action", "resource", "asn", "pc")}
        self.recent = Recent([x for x in recent if self.cut is None or x[0] >= self.cut])

    def fixed(self) -> tuple:
        lat, lon = self.place or (None, None)
        return (self.at, self.first, self.seen, self.logon, lat, lon, self.total, self.reads, self.hours, self.n_actions, self.seq, self.head, self.cut)

    def fading(self, since: float, now: float) -> float:
        return 2.0 ** (-max(0.0, now - since) / (M.HALF_LIFE_DAYS * 86400))

    def age(self, now: float) -> None:
        """Decay to ``now``; time that runs back decays nothing."""
        if self.at is not None and now > self.at:
            k = self.fading(self.at, now)
            self.total *= k
            self.reads *= k
            self.hours = [x * k for x in self.hours]
        self.at = now if self.at is None else max(now, self.at)

    def count(self, kind: str, key: str) -> float:
        """A key's count, decayed to ``at``."""
        found = self.maps[kind].get(key)
        return 0.0 if found is None else found[0] * self.fading(found[1], self.at)

    def distance(self, row: dict) -> float:
        if self.place is None or row.get("lat") is None:
            return 0.0
        a, b, turn = *map(math.radians, (self.place[0], row["lat"])), math.radians(row["lon"]) - math.radians(self.place[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(turn / 2) ** 2
        return 2 * M.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    def describe(self, row: dict, now: float) -> dict:
        """All features of a request, from the history that was taken in and from the request itself."""
        share = lambda part, default=0.0: part / self.total if self.total > 0 else default
        new = lambda kind, key: float(self.maps[kind].get(key) is None)
        self.cut = now - HOUR_S if self.cut is None else max(self.cut, now - HOUR_S)
        self.recent.forget(self.cut)
        action, resource = row["action"] or "", row["resource"] or ""
        pc, hour = row.get("pc") or "", int(row["hour"]) if row.get("hour") is not None else row["ts"].hour
        host = new("pc", pc) if pc else 1.0
        apart = abs(hour - max(range(24), key=lambda h: (self.hours[h], -h)))
        since = now - self.logon if self.logon is not None else None
        mfa = row.get("mfa_age")
        mfa = None if mfa is None else max(0.0, mfa)
        fading = self.fading(self.at, now) if self.at is not None else 1.0
        parts = [p for a in M.ACTIONS if (p := share(self.count("action", a))) > 0]
        own = {
            "role_tenure_days": (now - self.first) / 86400 if self.first is not None else 0.0,
            "policy_breadth": float(self.n_actions),
            "modal_hour_deviation": min(apart, 24 - apart) / 12 if self.total > 0 else 0.0,
            "log_inter_request_gap": math.log1p(max(0.0, now - self.seen)) if self.seen is not None else 0.0,
            "action_frequency": share(self.count("action", action)),
            "read_write_ratio": share(self.reads, 0.5),
            "first_time_action": new("action", action),
            "action_class_entropy": -sum(p * math.log(p) for p in parts) if parts else 0.0,
            "log_action_history": math.log1p(self.total * fading),
            "resource_sensitivity": row["sensitivity"],
            "resource_novelty": 1 - share(self.count("resource", resource)),
            "first_time_resource": new("resource", resource),
            "calls_1min": self.recent.since(now - 60), "calls_15min": self.recent.since(now - 900), "calls_60min": self.recent.since(self.cut),
            "log_bytes_read_60min": math.log1p(self.recent.bytes),
            "distinct_resources_60min": float(len(self.recent.resources)), "distinct_actions_60min": float(len(self.recent.actions)),
            "asn_novelty": new("asn", row.get("asn") or "AS0"),
            "geodesic_distance_km": self.distance(row),
            "device_fingerprint_match": 1.0 if row.get("managed") is True else 1 - host,
            "log_mfa_age": math.log1p(mfa) if mfa is not None else math.log1p(since) if since is not None else 0.0,
            "host_novelty": host,
        }
        return {k: 0.0 for k in M.FEATURES} | dict(row.get("context") or {}) | own

    def observe(self, row: dict, now: float) -> None:
        """Take a request in; the profile has been aged to it."""
        action, resource = row["action"] or "", row["resource"] or ""
        self.total += 1
        self.reads += action in M.READS
        self.hours[int(row["hour"]) if row.get("hour") is not None else row["ts"].hour] += 1
        self.n_actions += self.maps["action"].get(action) is None
        for kind, key in (("action", action), ("resource", resource), ("asn", row.get("asn") or "AS0"), ("pc", row.get("pc") or "")):
            if key or kind != "pc":
                self.maps[kind].put(key, (self.count(kind, key) + 1, self.at))
        self.recent.add((now, resource, action, int(row.get("bytes_read") or 0)))
        self.first = now if self.first is None else self.first
        self.seen = now
        self.place = [row["lat"], row["lon"]] if row.get("lat") is not None else self.place
        if action == "sts:AssumeRole":
            self.logon = now


def completed(requests: DataFrame) -> DataFrame:
    """The columns of REQUEST; those that ``requests`` lacks are null."""
    kinds = [c.split(" ", 1) for c in REQUEST.split(", ")]
    return requests.select(*[F.col(n) if n in requests.columns else F.lit(None).cast(t).alias(n) for n, t in kinds])


def records(pdf: pd.DataFrame) -> list[dict]:
    """The rows as dictionaries of plain values."""
    return [dict(zip(pdf.columns, row, strict=True)) for row in zip(*[pdf[c].tolist() for c in pdf.columns], strict=True)]


def decide(profile: Profile, rows: list[dict], score: Score) -> list[tuple]:
    """Decisions on requests in order; the profile is updated as they are taken."""
    out = []
    for row in rows:
        row = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in row.items()}
        now = row["ts"].value / 1e9
        f = profile.describe(row, now)
        profile.age(now)
        r = score(f)
        r_eff = effective(r, row["sensitivity"], row["credit"])
        verdict = verdict_of(r_eff)
        profile.seq += 1
        record = {"recId": f"{row['event_id']:012d}", "prevHash": profile.head, "seq": profile.seq, "ts": row["ts"].isoformat(), "principal": row["principal"], "action": row["action"], "resource": row["resource"], "r": r, "r_eff": r_eff, "verdict": verdict, "h_feat": None, "sig": ""}
        before, profile.head = profile.head, record_hash(record)
        out.append((row["event_id"], row["ts"], row["principal"], f["action_frequency"], f["resource_novelty"], f["calls_60min"], f["log_inter_request_gap"], r, r_eff, verdict, profile.seq, before, profile.head, [float(f[c]) for c in M.FEATURES]))
        if verdict != "DENY":
            profile.observe(row, now)
    return out


class Touched(Kept):
    """A map of the state: keys are read when they are asked for, and written back if they changed."""

    def __init__(self, state) -> None:
        super().__init__()
        self.state, self.changed = state, {}

    def find(self, key):
        found = self.state.getValue((key,))
        return None if found is None else tuple(found)

    def put(self, key, value: tuple) -> None:
        super().put(key, value)
        self.changed[key] = value

    def write(self) -> None:
        for key, value in self.changed.items():
            self.state.updateValue((key,), value)


class Decider(StatefulProcessor):
    """Decisions of a principal's requests; see ``online``."""

    def __init__(self, score: Score, ttl_ms: int | None, event_time: bool, few: int = FEW) -> None:
        self.score, self.ttl_ms, self.event_time, self.most = score, ttl_ms, event_time, 0 if ttl_ms is not None else few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fixed = handle.getValueState("fixed", FIXED)
        self.recent = handle.getListState("recent", "time double, resource string, action string, bytes long")
        self.few = handle.getListState("few", "kind string, key string, count double, at double")
        self.maps = {k: handle.getMapState(k, "key string", "count double, at double", self.ttl_ms) for k in ("action", "resource", "asn", "pc")}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.fixed.exists()
        # keys are in the list or in the maps, never in both; of a new principal there are none
        listed = self.few.exists() if known and self.most else bool(self.most)
        maps = self._listed(known) if listed else {k: Touched(m) for k, m in self.maps.items()}
        kept = [tuple(x) for x in self.recent.get()] if known and self.recent.exists() else []
        profile = Profile(tuple(self.fixed.get()) if known else None, kept, maps)
        live = len(profile.recent.left())
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        new: list[tuple] = []
        own, profile.recent.add = profile.recent.add, lambda row: (new.append(row), own(row))
        out = decide(profile, records(pdf), self.score)
        self.fixed.update(profile.fixed())
        if listed:
            self._keep(maps, known)
        else:
            for m in maps.values():
                m.write()
        # what has left the hour stays in the list until it is most of it
        if 2 * live < len(kept):
            self.recent.put(profile.recent.left()) if profile.recent.left() else self.recent.clear()
        elif new:
            self.recent.appendList(new)
        if self.event_time and profile.seen is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((profile.seen + HOUR_S) * 1000) + 1)
        yield pd.DataFrame(out, columns=NAMES)

    def _listed(self, known: bool) -> dict[str, Kept]:
        maps: dict[str, Kept] = {k: Kept() for k in self.maps}
        for kind, key, count, at in self.few.get() if known else ():
            maps[kind].put(key, (count, at))
        return maps

    def _keep(self, maps: dict[str, Kept], known: bool) -> None:
        """The keys as a list again, or in the maps from now on if they are many."""
        rows = [(kind, key, *value) for kind, m in maps.items() for key, value in m.known.items() if value is not None]
        if len(rows) > self.most:
            for kind, key, *value in rows:
                self.maps[kind].updateValue((key,), tuple(value))
            if known:
                self.few.clear()
        elif rows:
            self.few.put(rows)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the hour after the last request: nothing recent is left."""
        self.recent.clear()
        return iter([])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        head = initialState.iloc[0]
        self.fixed.update((None,) * 6 + (0.0, 0.0, [0.0] * 24, 0, int(head["head_seq"]), str(head["head_hash"]), None))

    def close(self) -> None:
        pass


NAMES = [c.split()[0] for c in DECISION.split(", ")]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def online(requests: DataFrame, score: Score = history_score, *, heads: DataFrame | None = None, watermark: str | None = None, ttl_ms: int | None = None, few: int = FEW) -> DataFrame:
    """Decisions of a stream of requests (columns of REQUEST).

    ``heads`` (principal, head_seq, head_hash), as a ledger has them, start the chains of a stream
    without a checkpoint: their next records follow the ledger's last. With ``watermark`` (a delay) the
    recent requests of principals that have been idle for an hour go by a timer; later rows than that are
    dropped. With ``ttl_ms`` actions, resources, networks and hosts that have not been seen for so long
    (of processing time) are forgotten: they count as new again; a stream that is to end where its input does then needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off. One of the two at most.

    The keys of a principal with up to ``few`` are kept as one list (with ``ttl_ms`` none are: each forgets for itself).

    The state is kept in a store with column families, which the session is set to.
    """
    if watermark is not None and ttl_ms is not None:
        raise ValueError("a watermark and a time to live exclude each other")
    spark = requests.sparkSession
    if spark.conf.get(STORE, "") != ROCKS:
        spark.conf.set(STORE, ROCKS)
    rows = completed(requests)
    if watermark is not None:
        rows = rows.withWatermark("ts", watermark)
    mode = "EventTime" if watermark is not None else "ProcessingTime" if ttl_ms is not None else "None"
    start = heads.select("principal", "head_seq", "head_hash").groupBy("principal") if heads is not None else None
    return rows.groupBy("principal").transformWithStateInPandas(Decider(score, ttl_ms, watermark is not None, few), DECISION, "Append", mode, start)


def replay(requests: DataFrame, score: Score = history_score) -> DataFrame:
    """The same decisions over a table: the fold runs within each principal's sorted rows."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, profile = None, Profile()
        for pdf in batches:
            out = []
            for principal, own in pdf.groupby("principal", sort=False):
                if principal != who:
                    who, profile = principal, Profile()
                out += decide(profile, records(own), score)
            yield pd.DataFrame(out, columns=NAMES)

    return completed(requests).repartition("principal").sortWithinPartitions("principal", "ts", "event_id").mapInPandas(fold, DECISION)
