import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import model as M
from tidewatch.operators import calibrate, ledger, metrics, models, rollup
from tidewatch.plans import chains, modelled
from tidewatch.streaming import online

SIGN = ledger.keyed_mac(b"k")


def scored(spark, y, s):
    return spark.createDataFrame(list(zip(y, map(float, s))), "y int, score double")


def test_threshold_metrics(spark):
    m = metrics.at_threshold(scored(spark, [0, 0, 0, 0, 1, 1], [0.1, 0.2, 0.9, 0.3, 0.95, 0.8])).first()
    assert (m["precision"], m["recall"], m["fpr"], m["positives"], m["predicted_positive"]) == (0.5, 0.5, 0.25, 2, 2)
    assert metrics.at_threshold(scored(spark, [0, 0], [0.1, 0.2])).first()["f1"] == 0


def test_auc_counts_ties_half_and_is_null_for_one_class(spark):
    random.seed(0)
    y, s = [random.randint(0, 1) for _ in range(60)], [random.randint(0, 8) / 8 for _ in range(60)]
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(scored(spark, y, s)).first()["auc"] == pytest.approx(want)
    assert metrics.roc_auc(scored(spark, [1, 1], [0.1, 0.2])).first()["auc"] is None


def test_best_threshold(spark):
    assert metrics.best_f1_threshold(scored(spark, [0, 1, 1], [0.1, 0.6, 0.9])).first()["threshold"] == 0.6
    assert metrics.best_f1_threshold(scored(spark, [0, 0], [0.1, 0.6])).first()["threshold"] == M.DENY


def test_ecdf_against_searchsorted(spark):
    rng = np.random.default_rng(0)
    cal, q = np.round(rng.random(400), 2), np.round(rng.random(300), 2)
    c = spark.createDataFrame([(float(v), "a" if i % 4 else "b") for i, v in enumerate(cal)], "v double, k string")
    d = spark.createDataFrame([(i, float(v), "ab"[i % 2]) for i, v in enumerate(q)], "i int, v double, k string")
    got = {r["i"]: r["f"] for r in calibrate.ecdf(c, d, "v").collect()}
    want = np.searchsorted(np.sort(cal), q, side="right") / len(cal)
    assert got == pytest.approx(dict(enumerate(want)))
    typed = {r["i"]: r["f"] for r in calibrate.ecdf_with_fallback(c, d, "v", "k").collect()}
    own = np.sort([v for i, v in enumerate(cal) if i % 4])
    assert all(typed[i] == pytest.approx(np.searchsorted(own, v, side="right") / len(own) if i % 2 == 0 else want[i]) for i, v in enumerate(q))


def decisions(spark, n=5, principals=("p", "q")):
    rows = [(f"{p}{i}", f"2024-01-01T00:00:{i:02d}", p, "a", "r", 0.1 * i, None, "ALLOW", "h") for p in principals for i in range(n)]
    return spark.createDataFrame(rows, "recId string, ts string, principal string, action string, resource string, r double, r_eff double, verdict string, h_feat string")


def broken(spark, records, heads=None, bad=None):
    return {r["principal"]: r["first_discontinuity"] for r in ledger.verify(ledger.with_hash(records), heads, bad).collect()}


def test_chains_verify_and_show_the_first_break(spark):
    r = ledger.chained(decisions(spark), SIGN).cache()
    heads = r.groupBy("principal").agg(F.max("seq").alias("head_seq"))
    assert broken(spark, r, heads) == {"p": -1, "q": -1}
    third, second, last = ((F.col("principal") == "p") & (F.col("seq") == s) for s in (3, 2, 5))
    assert broken(spark, ledger.tamper(r, "delete", third), heads)["p"] == 2
    assert broken(spark, ledger.tamper(r, "modify", second), heads)["p"] == 2  # by its successor's link alone
    forged = ledger.tamper(r, "modify", second)
    assert broken(spark, forged, heads, F.col("verdict") == "ALLOW_FORGED") == {"p": 1, "q": -1}
    assert broken(spark, ledger.tamper(r, "delete", last), heads)["p"] == 4
    assert broken(spark, ledger.tamper(r, "delete", last))["p"] == -1
    assert broken(spark, ledger.tamper(r, "delete", F.col("principal") == "p"), heads)["p"] == 0


def test_a_forged_last_record_shows_by_its_signature(spark):
    r = ledger.chained(decisions(spark), SIGN).cache()
    heads = r.groupBy("principal").agg(F.max("seq").alias("head_seq"))
    last = (F.col("principal") == "p") & (F.col("seq") == 5)
    bad = ledger.bad_signature(SIGN)
    assert broken(spark, r, heads, bad) == {"p": -1, "q": -1}
    for kind in ("modify", "backdate"):
        assert broken(spark, ledger.tamper(r, kind, last), heads)["p"] == -1
        assert broken(spark, ledger.tamper(r, kind, last), heads, bad) == {"p": 4, "q": -1}
    assert broken(spark, r.withColumn("sig", F.when(last, None).otherwise(F.col("sig"))), heads, bad)["p"] == 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_tamper_simulation_finds_every_victim_wherever_it_is(spark):
    got = chains.tamper_simulation(spark, "/root/testdata/sf0.001").withColumn("hit", F.pmod(F.xxhash64("principal"), F.lit(3)) == 0).cache()
    assert got.where("hit = intact").count() == 0 and got.where("hit").count() > 0
    modified = got.where("hit and kind = 'modify'")
    assert modified.where("first_discontinuity <> 1").count() > 0
    assert chains.chain_build_verified(spark, "/root/testdata/sf0.001").where("not intact").count() == 0


def test_admission_reasons(spark):
    r = ledger.chained(decisions(spark, 3, ("p",)), SIGN).collect()
    rows = [x.asDict() for x in r]
    rows.append(rows[0] | {})
    rows.append(rows[1] | {"recId": "new"})
    rows.append(rows[2] | {"recId": ""})
    bad = rows[2] | {"recId": "far", "seq": 9}
    rows.append(bad | {"sig": SIGN(ledger.canonical(bad))})
    t = spark.createDataFrame([x | {"arrival": i} for i, x in enumerate(rows)], "recId string, prevHash string, seq long, ts string, principal string, action string, resource string, r double, r_eff double, verdict string, h_feat string, sig string, arrival int")
    got = [x["reason"] for x in ledger.admit(t, SIGN).collect()]
    assert got == ["", "", "", "duplicate recId", "signature does not verify", "recId and principal are required", "seq discontinuity"]


def test_canonical_bytes():
    c = ledger.canonical({"recId": "é", "seq": 1, "r": 1e-05, "r_eff": 1.0, "verdict": 'a"b'}).decode()
    assert '"R":1.0' in c and '"r":1e-05' in c and "\\u00e9" in c and 'a\\"b' in c and '"ts":null' in c and " " not in c


def test_evidence(spark):
    e = spark.createDataFrame([("a", [1.0, 2.0], bytearray(b"s")), ("b", None, bytearray(b"s"))], "recId string, x array<float>, salt binary")
    r = e.select("recId", ledger.feature_digest(F.col("x"), F.col("salt")).alias("h_feat"))
    r = r.union(spark.createDataFrame([("c", "zz")], "recId string, h_feat string"))
    assert {x["recId"]: x["matches"] for x in ledger.recheck(r, e).collect()} == {"a": True, "b": True, "c": None}
    other = e.withColumn("x", F.array(F.lit(9.0)).cast("array<float>"))
    assert not any(x["matches"] for x in ledger.recheck(r, other).where("recId <> 'c'").collect())


def test_median_split_and_propagation(spark):
    days = spark.createDataFrame([("p", f"2024-01-0{i}", 1.0) for i in (1, 2, 3, 4, 5)], "principal string, day string, r double")
    assert {r["day"][-1]: r["side"] for r in rollup.median_day_split(days).collect()} == {"1": "early", "2": "early", "3": "late", "4": "late", "5": "late"}
    q = spark.createDataFrame([("p", "2024-01-01", 0.3), ("p", "2024-02-01", 0.4)], "principal string, day string, r double")
    assert sorted((r["r"], r["r_day"], r["r_max"]) for r in rollup.propagate(q, days).collect()) == [(0.3, 1.0, 1.0), (0.4, 0.0, 0.4)]


def test_standardiser_is_population_and_guards_constants(spark):
    t = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert {r["feature"]: (r["mean"], r["std"]) for r in rollup.moments(t, ("a", "b")).collect()} == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    assert sorted(tuple(r) for r in rollup.standardise(t, t, ("a", "b")).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_models_rank_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    t = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    far = np.full((1, 4), 8.0)
    f = models.fit_forest(t, list("abcd"), "id", trees=50)
    assert f.score(far)[0] > f.score(x).max()
    assert (f.score(x) == models.fit_forest(t.repartition(7), list("abcd"), "id", trees=50).score(x)).all()
    a = models.fit_autoencoder(t, list("abcd"), "id", (3, 2), epochs=5)
    assert a.score(far)[0] > np.median(a.score(x))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_ablation_has_all_variants_and_retrains_two(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(models, "fit_autoencoder", lambda x, columns, key, keep=models.fit_autoencoder: fitted.append((x, columns)) or keep(x, columns, key, epochs=2))
    got = {r["variant"] for r in modelled.ablation_variants(spark, "/root/testdata/sf0.001").collect()}
    assert got == {"full", "no_forest", "no_autoencoder", "alpha_0.4", "alpha_0.8", "no_sensitivity", "global_frequency", "no_volume"}
    assert [len(columns) for _, columns in fitted] == [33, 33, 27]
    shares = [x.select("action_frequency").distinct().count() for x, _ in fitted[:2]]
    assert shares[1] <= len(M.ACTIONS) < shares[0]


def test_fitted_queries_use_the_operators_defaults(monkeypatch):
    class Stop(Exception):
        pass

    def stop(*args, **params):
        raise Stop((len(args), params))

    class Rows:
        def __getattr__(self, name):
            return lambda *a, **k: self

    monkeypatch.setattr(modelled, "splits", lambda spark, d: Rows())
    monkeypatch.setattr(models, "fit_forest", lambda rows, columns, key: None)
    monkeypatch.setattr(models, "supervised", stop)
    monkeypatch.setattr(models, "fit_autoencoder", stop)
    for query, n in ((modelled.forest_risk, 5), (modelled.autoencoder_score, 3), (modelled.engine_risk, 3), (modelled.ablation_variants, 3)):
        with pytest.raises(Stop) as e:
            query(None, "")
        assert e.value.args[0] == (n, {})


def test_a_denied_request_does_not_enter_the_state():
    import pandas as pd

    row = lambda i, s: {"event_id": i, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), "principal": "p", "action": "a", "resource": "r", "bytes_read": 0, "sensitivity": 1.0, "credit": 0.0}
    denied, allowed = online.Profile(), online.Profile()
    out = online.decide(denied, [row(1, 0), row(2, 10)], lambda f: 1.0)
    assert [o[9] for o in out] == ["DENY", "DENY"] and denied.total == 0 and denied.seq == 2
    out = online.decide(allowed, [row(1, 0), row(2, 10)], lambda f: 0.0)
    assert allowed.total == pytest.approx(2, rel=1e-4) and out[1][3] == 1.0 and out[1][11] == out[0][12]
    again = online.Profile(allowed.fixed(), allowed.recent.left(), allowed.maps)
    assert again.fixed() == allowed.fixed() and again.recent.left() == allowed.recent.left()


def test_sampling_contributions_and_sinks(spark, tmp_path):
    from tidewatch.sources import sinks

    t = spark.range(2000)
    a, b = ({r["id"] for r in rollup.bernoulli(t, "id", 500).collect()} for _ in range(2))
    assert a == b and 400 < len(a) < 600 and rollup.bernoulli(t, "id", 5000).count() == 2000
    top = spark.range(1).select(rollup.top_contributions({"x": F.lit(1.0), "y": F.lit(-2.0), "z": F.lit(3.0)}, 2).alias("t")).first()["t"]
    assert [r["name"] for r in top] == ["z", "x"]
    records = ledger.chained(decisions(spark), SIGN)
    sinks.append_ledger(records, f"{tmp_path}/l")
    assert broken(spark, sinks.read_ledger(spark, f"{tmp_path}/l")) == {"p": -1, "q": -1}
    sinks.write_report(spark.createDataFrame([(1, "a")], "n int, s string"), f"{tmp_path}/r")
    assert spark.read.csv(f"{tmp_path}/r", header=True).first()["s"] == "a"


def test_stream_and_replay_agree(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:{i // 60:02d}", f"p{i % 3}", "ab"[i % 2], f"r{i % 5}", i, 0.5, 0.0) for i in range(150)]
    t = spark.createDataFrame(rows, "event_id long, ts string, principal string, action string, resource string, bytes_read long, sensitivity double, credit double").withColumn("ts", F.col("ts").cast("timestamp"))
    t.write.parquet(f"{tmp_path}/in")
    s = online.online(spark.readStream.schema(online.REQUEST).parquet(f"{tmp_path}/in"))
    s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    a, b = spark.read.parquet(f"{tmp_path}/out"), online.replay(t)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 150


# --- admission across principals, committer, challenges --------------------------------------


def admitted(spark, rows):
    sign = ledger.keyed_mac(b"k")
    out = []
    for n, (p, seq, prev, rec) in enumerate(rows):
        r = {"recId": rec, "prevHash": prev, "seq": seq, "ts": "t", "principal": p, "action": "a", "resource": "x", "r": 0.5, "r_eff": 0.5, "verdict": "ALLOW", "h_feat": "h", "sig": None}
        r["sig"] = sign(ledger.canonical(r))
        out.append(r | {"arrival": n})
    names = [*M.RECORD.names, "arrival"]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in out], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in M.RECORD.fields) + ", arrival long")
    return [r["reason"] for r in ledger.admit(df, sign).orderBy("arrival").collect()], out


def brute_admission(records):
    heads, seen, out = {}, set(), []
    for r in records:
        head = heads.get(r["principal"], (0, M.GENESIS))
        if r["recId"] in seen:
            out.append("duplicate recId")
        elif r["seq"] != head[0] + 1:
            out.append("seq discontinuity")
        elif r["prevHash"] != head[1]:
            out.append("prevHash mismatch")
        else:
            out.append("")
            seen.add(r["recId"])
            heads[r["principal"]] = (r["seq"], ledger.record_hash(r))
    return out


def test_a_rec_id_under_two_principals_is_accepted_once(spark):
    got, _ = admitted(spark, [("p", 1, M.GENESIS, "a"), ("q", 1, M.GENESIS, "a"), ("q", 1, M.GENESIS, "b")])
    assert got == ["", "duplicate recId", ""]
    # a refused record does not use its id up
    got, _ = admitted(spark, [("p", 5, M.GENESIS, "a"), ("q", 1, M.GENESIS, "a")])
    assert got == ["seq discontinuity", ""]


def test_admission_against_one_pass_in_arrival_order(spark):
    import random

    random.seed(3)
    for _ in range(4):
        rows = [(random.choice("pqr"), random.choice([1, 1, 2]), M.GENESIS, random.choice("abcd")) for _ in range(12)]
        got, records = admitted(spark, rows)
        assert got == brute_admission(records), rows


def test_the_committer_goes_on_after_a_restart(spark, tmp_path):
    from tidewatch.streaming import committer

    sign, base = ledger.keyed_mac(b"k"), f"file://{tmp_path}"
    r = ledger.materialise(ledger.chained(decisions(spark, 6), sign).withColumn("arrival", F.col("seq")), "chains")
    stream = lambda: spark.readStream.schema(r.schema).parquet(f"{base}/in")
    r.where("seq <= 3").write.parquet(f"{base}/in")
    committer.commit(stream(), f"{base}/ledger", f"{base}/cp", sign).awaitTermination()
    first = committer.counters(spark, f"{base}/ledger", r).first()
    r.where("seq >= 3").write.mode("append").parquet(f"{base}/in")
    committer.commit(stream(), f"{base}/ledger", f"{base}/cp", sign).awaitTermination()
    last = committer.counters(spark, f"{base}/ledger", spark.read.parquet(f"{base}/in")).first()
    n = r.where("seq = 3").count()
    assert first["committed"] == r.where("seq <= 3").count() and (last["committed"], last["rejected"], last["pending"]) == (r.count(), n, 0)
    assert {x["reason"] for x in committer.rejected(spark, f"{base}/ledger").collect()} == {"duplicate recId"}
    done = ledger.with_hash(committer.committed(spark, f"{base}/ledger"))
    assert all(x["intact"] for x in ledger.verify(done, bad_signature=ledger.bad_signature(sign)).collect())


def test_the_online_stream_goes_on_after_a_restart(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=60 * i), "p", "s3:GetObject", f"r{i % 2}", 1, 0.3, 0.0) for i in range(6)]
    names = online.REQUEST.split(", ")
    full = lambda part: spark.createDataFrame([(*r, "pc", "AS1", 1.0, 2.0, 0, None, None, {}) for r in part], online.REQUEST)
    assert len(names) == 16
    for part in (rows[:3], rows[3:]):
        full(part).write.mode("append").parquet(f"{base}/in")
        q = online.online(spark.readStream.schema(online.REQUEST).parquet(f"{base}/in")).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(online.DECISION).parquet(f"{base}/out").orderBy("event_id").collect()
    want = online.replay(full(rows)).orderBy("event_id").collect()
    assert [r["seq"] for r in got] == [1, 2, 3, 4, 5, 6] and got[3]["prevHash"] == got[2]["hash"]
    assert [(r["verdict"], r["hash"], r["calls_60min"]) for r in got] == [(r["verdict"], r["hash"], r["calls_60min"]) for r in want]


def test_live_context_overrides_three_features():
    import pandas as pd

    p = online.Profile()
    row = {"event_id": 1, "ts": pd.Timestamp("2024-01-01 10:00"), "principal": "p", "action": "sts:AssumeRole", "resource": "r", "bytes_read": 0, "sensitivity": 0.7, "credit": 0.0, "pc": "x"}
    online.decide(p, [row], lambda f: 0.0)
    f = p.describe(row | {"pc": "new", "managed": True, "mfa_age": -5.0}, 1704103260.0)
    assert (f["resource_sensitivity"], f["device_fingerprint_match"], f["host_novelty"], f["log_mfa_age"]) == (0.7, 1.0, 1.0, 0.0)
    f = p.describe(row | {"pc": "new"}, 1704103260.0)
    assert f["device_fingerprint_match"] == 0.0 and f["log_mfa_age"] == pytest.approx(np.log1p(60))


def test_challenges():
    from tidewatch.streaming import challenge

    sign = ledger.keyed_mac(b"k")
    t = challenge.issue(sign, "p|x", "a.b", "r%7C", 1000.0, "n")
    ok = lambda token, *what, now=1299.0: challenge.valid(sign, token, *(what or ("p|x", "a.b", "r%7C")), now)
    assert ok(t) and not ok(t, now=1300.0) and not ok(t, "p", "a.b", "r%7C") and not ok(t[:-1] + ("0" if t[-1] != "0" else "1"))
    assert not any(ok(x) for x in (None, "", "x", "a|b|c|d|e.f", t.replace("1300", "9999")))
    assert not challenge.valid(ledger.keyed_mac(b"other"), t, "p|x", "a.b", "r%7C", 1001.0)


def test_a_key_is_installed_once(spark, tmp_path):
    from tidewatch.sources import sinks

    sinks.install_key(spark, f"{tmp_path}/key", "k1", "f")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.install_key(spark, f"{tmp_path}/key", "k2", "f")
    assert spark.read.json(f"{tmp_path}/key").first()["key_id"] == "k1"


# --- running sums, engines -----------------------------------------------------------------


def test_running_sums_against_one_window(spark):
    import random

    from tidewatch.operators.running import running

    random.seed(2)
    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, 1e9, -500.0, 0.5, 0.50001] + [random.gauss(0, 2) for _ in range(200)]
    rows = [(g, v, random.randint(0, 5)) for g in ("a", None) for v in values]
    t = spark.createDataFrame(rows, "g string, v double, n int")
    rank = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    for by in ((), ("g",)):
        one = t if by else t.where("g = 'a'")
        src = rows if by else [r for r in rows if r[0] == "a"]
        for down, strict in ((False, False), (True, False), (False, True)):
            got = {(r["g"], repr(r["v"])): r["s"] for r in running(one, "v", {"s": "n"}, by, descending=down, strict=strict).collect()}
            for g, v, _ in src:
                before = lambda x: (rank(x) > rank(v) if down else rank(x) < rank(v)) or (not strict and rank(x) == rank(v))  # noqa: B023, E731
                assert got[g, repr(v)] == sum(n for h, x, n in src if h == g and before(x)), (by, down, strict, v)


def test_quantiles_are_exact(spark):
    from tidewatch.operators.running import quantiles

    random.seed(5)
    rows = [(g, random.choice([random.gauss(0, 3), random.expovariate(1e-9), float(random.randint(0, 3)), None])) for g in ("a", "b", None) for _ in range(700)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    t = spark.createDataFrame(rows, "g string, v double").cache()
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    got = {r["g"]: r for r in quantiles(t, "v", shares, ("g",)).collect()}
    want = {r["g"]: r for r in t.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()]).collect()}
    assert set(got) == set(want) - {"none"}
    assert all(got[g][n] == pytest.approx(want[g][n], rel=1e-12) for g in got for n in shares)
    assert quantiles(t, "v", shares).first()["p95"] == pytest.approx(t.agg(F.percentile("v", 0.95)).first()[0], rel=1e-12)
    assert quantiles(t.limit(0), "v", shares).first()["p95"] is None and quantiles(t.limit(0), "v", shares, ("g",)).count() == 0


def test_large_values_spread_over_buckets(spark):
    from tidewatch.operators import running

    t = spark.range(20_000).withColumn("v", F.col("id") * 1e6 + 1e9)
    sizes = [r["count"] for r in t.groupBy(running.bucket_of(F.col("v"), running.bounds(t, "v"))).count().collect()]
    assert len(sizes) > 100 and max(sizes) < 500


def test_percentiles_in_bounded_memory(spark):
    t = spark.range(10_000).withColumn("v", F.col("id").cast("double"))
    exact, near = (metrics.percentiles(t, "v", (), a).first() for a in (None, 1000))
    assert abs(exact["p95"] - near["p95"]) <= 20 and exact["mean"] == near["mean"]


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = models.Autoencoder([rng.normal(size=s) for s in ((3, 4), (4, 2), (2, 4), (4, 3))], [rng.normal(size=n) for n in (4, 2, 4, 3)], np.zeros(3), np.ones(3), [rng.normal(size=4) for _ in range(2)], [rng.normal(size=4) for _ in range(2)], [np.zeros(4)] * 2, [np.ones(4)] * 2)
    assert net.inner() == [0, 2]
    x, drops = rng.normal(size=(7, 3)), [(rng.random((7, 4)) > 0.2) / 0.8 for _ in range(2)]
    *grads, _, _ = models.gradients(net, x, drops)
    for params, found in zip((net.weights, net.biases, net.scales, net.shifts), grads, strict=True):
        for p, g in zip(params, found, strict=True):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-6
            up = models.gradients(net, x, drops)[-1]
            p[at] = old - 1e-6
            down = models.gradients(net, x, drops)[-1]
            p[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4 * (1 + abs(g[at]))


def test_engines_are_kept_recalibrated_and_fitted_by_type(spark, tmp_path, monkeypatch):
    from tidewatch.operators import engines

    monkeypatch.setattr(models, "fit_autoencoder", lambda *a, keep=models.fit_autoencoder: keep(*a, (3, 2), epochs=3))
    monkeypatch.setattr(models, "fit_forest", lambda *a, keep=models.fit_forest: keep(*a, trees=20))
    rng = np.random.default_rng(0)
    rows = [(i, "big" if i % 3 else "mid" if i % 2 else "rare" if i % 60 == 0 else "big", *map(float, rng.normal(i % 3, 1, 3))) for i in range(1500)]
    t = spark.createDataFrame(rows, "event_id long, kind string, x double, y double, z double")
    train, val, test = t.where("event_id < 900"), t.where("event_id between 900 and 1199"), t.where("event_id >= 1200")
    e = engines.fit(train, val, ("x", "y", "z"))
    engines.save(e, f"{tmp_path}/e")
    kept = engines.load(spark, f"{tmp_path}/e")
    scores = lambda engine: {r["event_id"]: (r["f_e"], r["f_s"], r["r_0.6"]) for r in engines.score(engine, test).collect()}
    assert scores(e) == scores(kept) and all(0 <= x <= 1 for v in scores(e).values() for x in v)
    again = engines.calibrated_on(kept, test, typed=False)
    assert again.forest is kept.forest and scores(again) != scores(kept)
    assert max(v[0] for v in scores(again).values()) == 1.0
    own, default = engines.fit_by_type(train, val, ("x", "y", "z"), least=100)
    assert set(own) == {"big", "mid"} and default == "big"
    engines.save_by_type(own, default, f"{tmp_path}/t")
    own, default = engines.load_by_type(spark, f"{tmp_path}/t")
    got = engines.score_by_type(own, default, test).groupBy("kind", "engine").count().collect()
    assert {(r["kind"], r["engine"]) for r in got} == {("big", "big"), ("mid", "mid"), ("rare", "big")} and sum(r["count"] for r in got) == test.count()
