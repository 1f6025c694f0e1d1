"""The online path on typed state: batches, restart from the ledger, forgetting, bursts."""

import datetime as dt
import random
import time

import pandas as pd
import pytest

from tidewatch import model as M
from tidewatch.streaming import online

pytest.importorskip("google.protobuf")
T0 = dt.datetime(2024, 1, 1)


def requests(spark, rows):
    """rows: (id, seconds, principal, action, resource, pc)"""
    full = [(i, T0 + dt.timedelta(seconds=s), p, a, r, i % 7, 0.3, 0.0, pc, f"AS{i % 3}", float(i % 5), 2.0, 0, None, None, {}) for i, s, p, a, r, pc in rows]
    return spark.createDataFrame(full, online.REQUEST)


def mild(features):
    """Few are denied."""
    return min(1.0, 0.2 + 0.4 * features["calls_1min"])


def zero(features):
    return 0.0


def some(n, seed=1, gap=2000):
    random.seed(seed)
    at, out = 0, []
    for i in range(n):
        at += random.choice([0, 1, 60, gap])
        out.append((i, at, random.choice("pq"), random.choice([*M.ACTIONS, "x"]), f"r{random.randint(0, 9)}", random.choice(["", "a", "b"])))
    return out


def run(spark, base, part, checkpoint="cp", out="out", **how):
    requests(spark, part).coalesce(1).write.mode("append").parquet(f"{base}/in-{checkpoint}")
    stream = online.online(spark.readStream.schema(online.REQUEST).parquet(f"{base}/in-{checkpoint}"), **how)
    stream.writeStream.format("parquet").option("path", f"{base}/{out}").option("checkpointLocation", f"{base}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    return {r["event_id"]: r for r in spark.read.schema(online.DECISION).parquet(f"{base}/{out}").collect()}


def test_batches_equal_one_replay(spark, tmp_path):
    rows = some(120)
    for lo in range(0, 120, 40):
        got = run(spark, f"file://{tmp_path}", rows[lo : lo + 40], score=mild)
    want = {r["event_id"]: r for r in online.replay(requests(spark, rows), mild).collect()}
    assert got == want and len(got) == 120 and 5 < sum(r["verdict"] == "DENY" for r in got.values()) < 115


def test_a_stream_without_checkpoint_goes_on_from_the_ledgers_heads(spark, tmp_path):
    base, rows = f"file://{tmp_path}", some(60)
    first = run(spark, base, rows[:30])
    last = {}
    for r in first.values():
        last[r["principal"]] = max(last.get(r["principal"], (0, "")), (r["seq"], r["hash"]))
    heads = spark.createDataFrame([(p, *x) for p, x in last.items()] + [("idle", 9, "f" * 64)], "principal string, head_seq long, head_hash string")
    second = run(spark, base, [*rows[30:], (900, 10**6, "new", "x", "r", "a")], "other", "out2", heads=heads)
    for p in "pq":
        own = sorted((r for r in second.values() if r["principal"] == p), key=lambda r: r["seq"])
        assert (own[0]["seq"], own[0]["prevHash"]) == (last[p][0] + 1, last[p][1]) and all(b["prevHash"] == a["hash"] for a, b in zip(own, own[1:]))
    assert second[900]["seq"] == 1 and second[900]["prevHash"] == M.GENESIS
    third = run(spark, base, [(901, 10**6 + 5, "idle", "x", "r", "a")], "other", "out2", heads=heads)
    assert (third[901]["seq"], third[901]["prevHash"]) == (10, "f" * 64)


def test_keys_are_forgotten_after_their_time_to_live(spark, tmp_path, request):
    # processing time has another batch at any time: without this a stream that is used up goes on
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled"))
    base, row = f"file://{tmp_path}", (0, 0, "p", "x", "r", "a")
    run(spark, base, [row], ttl_ms=1500, score=zero)
    time.sleep(2.5)
    got = run(spark, base, [(1, 10, "p", "x", "r", "a"), (2, 20, "p", "x", "r", "a")], ttl_ms=1500, score=zero)
    names = list(M.FEATURES)
    new = lambda i: [got[i]["features"][names.index(c)] for c in ("first_time_resource", "host_novelty")]
    assert (new(0), new(1), new(2)) == ([1, 1], [1, 1], [0, 0]) and got[2]["seq"] == 3 and got[2]["calls_60min"] == 2
    with pytest.raises(ValueError):
        online.online(spark.readStream.schema(online.REQUEST).parquet(f"{base}/in-cp"), ttl_ms=1, watermark="1 hour")


def test_an_idle_hour_ends_by_a_timer(spark, tmp_path):
    base, how = f"file://{tmp_path}", {"watermark": "0 seconds", "score": zero}
    rows = [(0, 0, "p", "x", "r", "a"), (1, 10, "p", "x", "r", "a")]
    run(spark, base, rows, **how)
    run(spark, base, [(2, 9000, "q", "x", "r", "a")], **how)  # moves the watermark on
    run(spark, base, [(3, 9100, "q", "x", "r", "a")], **how)
    got = run(spark, base, [(4, 9200, "p", "x", "r", "a")], **how)
    want = {r["event_id"]: r for r in online.replay(requests(spark, [*rows, (2, 9000, "q", "x", "r", "a"), (3, 9100, "q", "x", "r", "a"), (4, 9200, "p", "x", "r", "a")]), zero).collect()}
    assert got == want


class State:
    """A map state that counts what is read and written."""

    def __init__(self):
        self.kept, self.reads, self.writes = {}, 0, 0

    def getValue(self, key):
        self.reads += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.writes += 1
        self.kept[key] = value


def test_only_touched_keys_are_read_and_written():
    state = State()
    state.kept = {(f"k{i}",): (1.0, 0.0) for i in range(1000)}
    m = online.Touched(state)
    assert m.get("k1") == (1.0, 0.0) and m.get("k1") and m.get("none") is None
    m.put("k2", (5.0, 1.0))
    m.write()
    assert (state.reads, state.writes, state.kept[("k2",)]) == (2, 1, (5.0, 1.0)) and m.get("k2") == (5.0, 1.0)


def test_the_last_hour_against_a_plain_list():
    random.seed(3)
    recent, plain, cut = online.Recent(), [], 0.0
    for _ in range(3000):
        now = cut + 3600 + random.choice([-500, 0, 1, 30, 700])
        cut = max(cut, now - 3600)
        recent.forget(cut)
        plain = [x for x in plain if x[0] >= cut]
        assert [recent.since(now - s) for s in (60, 900)] == [sum(now - x[0] <= s for x in plain) for s in (60, 900)]
        assert (recent.since(cut), recent.bytes, set(recent.resources), set(recent.actions)) == (len(plain), sum(x[3] for x in plain), {x[1] for x in plain}, {x[2] for x in plain})
        row = (now, random.choice("abc"), random.choice("xy"), random.randint(0, 9))
        recent.add(row)
        plain.append(row)


def test_a_burst_costs_what_its_requests_cost():
    def took(n):
        rows = [{"event_id": i, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=i), "principal": "p", "action": "x", "resource": f"r{i % 50}", "bytes_read": 1, "sensitivity": 0.1, "credit": 0.0} for i in range(n)]
        began = time.process_time()
        out = online.decide(online.Profile(), rows, lambda f: 0.0)
        assert out[-1][5] == n - 1
        return time.process_time() - began

    took(500)
    assert took(16_000) < 8 * took(4_000)  # four times the requests; the square would be sixteen



class Calls:
    """A handle whose states count the calls that a worker makes."""

    def __init__(self):
        self.n, self.states = 0, {}

    def state(self, name, *_):
        return self.states.setdefault(name, CountedState(self))

    getValueState = getListState = getMapState = state


class CountedState:
    def __init__(self, calls):
        self.calls, self.value, self.map = calls, None, {}

    def __getattribute__(self, name):
        if name not in ("calls", "value", "map") and not name.startswith("__"):
            object.__getattribute__(self, "calls").n += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.value = None

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value


@pytest.mark.parametrize("few", [256, 8])
def test_few_keys_are_one_list_and_many_go_to_the_maps(few):
    def frame(lo, hi):
        return pd.DataFrame([{"event_id": i, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), "principal": "p", "action": f"x{i % 5}", "resource": f"r{i % 40}", "bytes_read": 1, "sensitivity": 0.1, "credit": 0.0, "pc": f"h{i % 7}", "asn": f"a{i % 7}"} for i in range(lo, hi)])

    calls, decider = Calls(), online.Decider(zero, None, False, few)
    decider.init(calls)
    got = []
    for lo in (0, 4, 60, 120):
        before = calls.n
        got += pd.concat(decider.handleInputRows(("p",), iter([frame(lo, {0: 4, 4: 60, 60: 120, 120: 180}[lo])]), None)).to_dict("records")
        assert few == 8 or calls.n - before <= 12
    want = online.decide(online.Profile(), online.records(frame(0, 180)), zero)
    assert [r["hash"] for r in got] == [r[12] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a["features"] == pytest.approx(b[13], rel=1e-9, abs=1e-9)
    assert bool(calls.states["few"].value) == (few == 256) and bool(calls.states["resource"].map) == (few == 8)


def test_a_stream_whose_keys_outgrow_the_list_equals_one_replay(spark, tmp_path):
    rows = some(90)
    for lo in range(0, 90, 30):
        got = run(spark, f"file://{tmp_path}", rows[lo : lo + 30], score=mild, few=16)
    want = {r["event_id"]: r for r in online.replay(requests(spark, rows), mild).collect()}
    assert got == want and len(got) == 90
