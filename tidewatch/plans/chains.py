"""Queries over decision chains and the online path."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch import model as M
from tidewatch.functions import columns as C
from tidewatch.operators import history, ledger, lookup
from tidewatch.plans.catalog import effective, query, risk
from tidewatch.plans.sql import EV
from tidewatch.session import materialise, scratch
from tidewatch.sources import proxy
from tidewatch.streaming import challenge, committer, online

#: Keyed stand-in for a signature; a deployment hands in its own signer.
SIGN = ledger.keyed_mac(b"example key")

# Plain chains: a row's hash is of its own id, action and place alone, so that SQL can follow it.
# Some rows are tampered with: dropped (id % 211), or their link altered (id % 307).
_PLAIN = f"""{EV}, p0 AS (SELECT event_id, principal, action, row_number() OVER (PARTITION BY principal ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY principal) AS head_seq FROM ev),
p1 AS (SELECT *, sha256(principal || '|' || seq || '|' || event_id || '|' || action) AS hash FROM p0),
p2 AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY principal ORDER BY seq), repeat('0', 64)) AS prevHash FROM p1),
rec AS (SELECT event_id, principal, action, seq, hash, CASE WHEN event_id % 307 = 0 THEN repeat('f', 64) ELSE prevHash END AS prevHash FROM p2 WHERE event_id % 211 <> 0),
heads AS (SELECT DISTINCT principal, head_seq FROM p0),
v0 AS (SELECT *, row_number() OVER (PARTITION BY principal ORDER BY seq, event_id) - 1 AS pos, coalesce(lag(hash) OVER (PARTITION BY principal ORDER BY seq, event_id), repeat('0', 64)) AS prev FROM rec),
v1 AS (SELECT principal, count(*) AS records, min(CASE WHEN seq <> pos + 1 OR prevHash <> prev THEN pos END) AS broken_at FROM v0 GROUP BY 1),
ver AS (SELECT h.principal, coalesce(records, 0) AS records, CAST(coalesce(broken_at, CASE WHEN head_seq <> coalesce(records, 0) THEN coalesce(records, 0) END, -1) AS BIGINT) AS first_discontinuity FROM heads h LEFT JOIN v1 USING (principal))"""


def untouched(spark, d, *more: str) -> DataFrame:
    """The chains before anything is done to them; prev is the true link. ``more``: further columns of the events."""
    e = proxy.events(spark, d) if more else proxy.raw_events(spark, d)
    own = Window.partitionBy("principal").orderBy("ts", "event_id")
    p = e.select("event_id", "principal", "action", *more, F.row_number().over(own).cast("long").alias("seq"))
    p = p.withColumn("hash", F.sha2(F.concat_ws("|", "principal", F.col("seq").cast("string"), F.col("event_id").cast("string"), "action"), 256))
    return p.withColumn("prev", F.coalesce(F.lag("hash").over(Window.partitionBy("principal").orderBy("seq")), F.lit("0" * 64)))


def plain(spark, d, *more: str) -> tuple[DataFrame, DataFrame]:
    p = untouched(spark, d, *more)
    p = p.withColumn("prevHash", F.when(F.col("event_id") % 307 == 0, "f" * 64).otherwise(F.col("prev"))).withColumn("recId", F.format_string("%012d", "event_id")).drop("prev")
    heads = p.groupBy("principal").agg(F.max("seq").alias("head_seq"))
    return p.where("event_id % 211 <> 0"), heads


@query(f"WITH {_PLAIN} SELECT principal, records, first_discontinuity = -1 AS intact, first_discontinuity FROM ver")
def chain_verify(spark, d):
    records, heads = plain(spark, d)
    return ledger.verify(records, heads)


@query(f"WITH {_PLAIN} SELECT v0.principal, v0.seq, v0.event_id, v0.pos FROM v0 JOIN ver USING (principal) WHERE ver.first_discontinuity >= 0 AND abs(v0.pos - ver.first_discontinuity) <= 3")
def chain_context_rows(spark, d):
    records, heads = plain(spark, d)
    at = ledger.verify(records, heads).where("not intact").select("principal", "first_discontinuity")
    rows = records.withColumn("pos", F.row_number().over(Window.partitionBy("principal").orderBy("seq", "recId")).cast("long") - 1)
    return rows.join(at, "principal").where(F.abs(F.col("pos") - F.col("first_discontinuity")) <= 3).select("principal", "seq", "event_id", "pos")


_DONE = """t AS (SELECT principal, seq, prevHash AS prev, 'delete' AS kind FROM p2 WHERE event_id % 211 = 0 UNION ALL SELECT principal, seq, prevHash, 'relink' FROM p2 WHERE event_id % 307 = 0),
j AS (SELECT t.kind, CASE t.kind WHEN 'delete' THEN rec.seq IS NULL ELSE coalesce(rec.prevHash <> t.prev, false) END AS ok, first_discontinuity BETWEEN 0 AND t.seq - 1 AS found FROM t LEFT JOIN rec ON t.principal = rec.principal AND t.seq = rec.seq JOIN ver ON t.principal = ver.principal)"""


@query(f"WITH {_PLAIN}, {_DONE} SELECT coalesce(kind, 'total') AS kind, count(*) AS attempts, CAST(sum(ok::INT) AS BIGINT) AS succeeded, CAST(sum((ok AND found)::INT) AS BIGINT) AS detected FROM j GROUP BY ROLLUP (kind)")
def tamper_found(spark, d):
    """What was done to the plain chains, what of it is in the ledger, and what of that the check finds."""
    p, (records, heads) = untouched(spark, d), plain(spark, d)
    i = F.col("event_id")
    kinds = F.filter(F.array(F.when(i % 211 == 0, "delete"), F.when(i % 307 == 0, "relink")), lambda k: k.isNotNull())
    attempts = p.select("principal", "seq", "prev", F.explode(kinds).alias("kind"))
    now = records.select("principal", "seq", F.col("prevHash").alias("_link"))
    stands = F.when(F.col("kind") == "delete", F.col("_link").isNull()).otherwise(F.coalesce(F.col("_link") != F.col("prev"), F.lit(False)))
    done = attempts.join(now, ["principal", "seq"], "left").select("principal", "seq", "kind", stands.alias("succeeded"))
    return ledger.tamper_table(done, ledger.verify(records, heads))


@query(f"WITH {_PLAIN} SELECT principal, seq, event_id, action FROM rec WHERE principal = '11' ORDER BY seq")
def records_by_principal(spark, d):
    return plain(spark, d)[0].where("principal = '11'").orderBy("seq").select("principal", "seq", "event_id", "action")


@query(f"WITH {EV} SELECT resource, principal, event_id FROM ev WHERE resource = 'arn:aws:execute-api:::site-7'")
def records_by_resource(spark, d):
    return proxy.events(spark, d).where("resource = 'arn:aws:execute-api:::site-7'").select("resource", "principal", "event_id")


_SITE = "arn:aws:execute-api:::site-7"
_laid: dict[tuple[str, str], str] = {}


def laid_out(spark, d) -> str:
    """The plain chains laid out for look-ups, once an application."""
    if (key := (spark.sparkContext.applicationId, d)) not in _laid:
        path = scratch(spark, "lookup")
        lookup.lay_out(plain(spark, d, "resource")[0], path)
        _laid[key] = path
    return _laid[key]


@query(f"WITH {_PLAIN} SELECT principal, seq, event_id, action, resource, hash FROM rec JOIN (SELECT event_id, resource FROM ev) USING (event_id) WHERE principal = '11'")
def laid_out_by_principal(spark, d):
    return lookup.by_principal(spark, laid_out(spark, d), "11").select("principal", "seq", "event_id", "action", "resource", "hash")


@query(f"WITH {_PLAIN} SELECT principal, seq, event_id, action, resource, hash FROM rec JOIN (SELECT event_id, resource FROM ev) USING (event_id) WHERE resource = '{_SITE}'")
def laid_out_by_resource(spark, d):
    return lookup.by_resource(spark, laid_out(spark, d), _SITE).select("principal", "seq", "event_id", "action", "resource", "hash")


@query(f"WITH {_PLAIN} SELECT principal, max(seq) AS head_seq, arg_max(hash, seq) AS head_hash FROM rec GROUP BY 1")
def chain_heads(spark, d):
    return plain(spark, d)[0].groupBy("principal").agg(F.max("seq").alias("head_seq"), F.max_by("hash", "seq").alias("head_hash"))


def decisions(spark, d) -> DataFrame:
    e = proxy.events(spark, d)
    return e.select(
        F.format_string("%012d", "event_id").alias("recId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("ts"), "principal", "action", "resource",
        F.round(risk(), 8).alias("r"), F.round(effective(), 8).alias("r_eff"), C.band(effective()).alias("verdict"), F.sha2(F.col("event_id").cast("string"), 256).alias("h_feat"),
    )


def chains(spark, d) -> DataFrame:
    """The decisions' chains, folded once and written: what follows reads them several times, with Python of its own."""
    return materialise(ledger.chained(decisions(spark, d), SIGN), "chains")


@query()
def chain_build(spark, d):
    return ledger.with_hash(ledger.chained(decisions(spark, d), SIGN))


@query()
def chain_build_verified(spark, d):
    return ledger.verify(ledger.with_hash(chains(spark, d)), bad_signature=ledger.bad_signature(SIGN))


@query()
def ledger_admission(spark, d):
    r = chains(spark, d).withColumn("arrival", F.col("seq") * 2)
    again = r.where(F.col("seq") % 9 == 0).withColumn("arrival", F.col("arrival") + 1)
    forged = r.where(F.col("seq") % 11 == 0).withColumn("recId", F.concat(F.lit("x"), "recId")).withColumn("arrival", F.col("arrival") + 1)
    stolen = r.where(F.col("seq") % 13 == 0).withColumn("principal", F.concat(F.lit("x"), "principal")).withColumn("arrival", F.col("arrival") + 1)
    return ledger.admit(r.unionByName(again).unionByName(forged).unionByName(stolen), SIGN)


@query()
def tamper_simulation(spark, d):
    """A third of the chains have one record tampered with, at a place by hash: any, the last included."""
    r = chains(spark, d)
    heads = r.groupBy("principal").agg(F.max("seq").alias("head_seq"))
    length = F.max("seq").over(Window.partitionBy("principal"))
    r = r.withColumn("_place", F.pmod(F.xxhash64("principal", F.lit("place")), length) + 1)
    hit = (F.pmod(F.xxhash64("principal"), F.lit(3)) == 0) & (F.col("seq") == F.col("_place"))
    out = None
    for kind in ("delete", "modify", "backdate", "fabricate"):
        v = ledger.verify(ledger.with_hash(ledger.tamper(r, kind, hit)), heads, ledger.bad_signature(SIGN)).withColumn("kind", F.lit(kind))
        out = v if out is None else out.unionByName(v)
    return out


@query()
def evidence_recheck(spark, d):
    x = F.array(F.col("event_id").cast("float"), F.col("bytes_read").cast("float"))
    e = proxy.raw_events(spark, d).select(F.format_string("%012d", "event_id").alias("recId"), x.alias("x"), F.encode(F.col("pc"), "utf-8").alias("salt"), "event_id")
    records = e.select("recId", ledger.feature_digest(F.when(F.col("event_id") % 50 != 0, F.col("x")), F.col("salt")).alias("h_feat"))
    return ledger.recheck(records, e.where("event_id % 33 <> 0"))


# --- the online path -----------------------------------------------------------------------


def requests(spark, d) -> DataFrame:
    """The events as live requests: their context, and what needs no history, beside them."""
    e = history.spread_features(proxy.events(spark, d), online.CONTEXT, counted=proxy.raw_events(spark, d))
    s = C.sensitivity(F.col("action"), F.col("resource"), F.col("egress"))
    context = F.create_map(*[x for c in online.CONTEXT for x in (F.lit(c), F.col(c))])
    return e.select(
        "event_id", "ts", "principal", "action", "resource", "bytes_read", s.cast("double").alias("sensitivity"), ((F.col("event_id") % 3) / 2.0).alias("credit"), "pc", "asn", "lat", "lon",
        F.hour("ts").alias("hour"), F.lit(None).cast("boolean").alias("managed"), F.lit(None).cast("double").alias("mfa_age"), context.alias("context"),
    )


def streamed(spark, d) -> DataFrame:
    """The requests written to the shared folder and read as a stream until it is used up."""
    base = scratch(spark, "online")
    requests(spark, d).write.parquet(f"{base}/in")
    return decided(spark, base)


def decided(spark, base: str) -> DataFrame:
    stream = spark.readStream.schema(online.REQUEST).parquet(f"{base}/in")
    q = online.online(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(online.DECISION).parquet(f"{base}/out")


@query()
def online_decisions_stream(spark, d):
    return streamed(spark, d)


@query()
def stream_equals_batch(spark, d):
    """Rows in which the stream and the replay differ: none."""
    base = scratch(spark, "online")
    requests(spark, d).write.parquet(f"{base}/in")  # both take the same, made once
    a, b = decided(spark, base), online.replay(spark.read.schema(online.REQUEST).parquet(f"{base}/in"))
    same = [c for c in a.columns if c != "event_id"]
    both = a.alias("a").join(b.alias("b"), "event_id", "full")
    differs = None
    for c in same:
        x = ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        differs = x if differs is None else differs | x
    return both.groupBy().agg(F.count("*").alias("rows"), F.count(F.when(differs, 1)).alias("different"))


@query()
def online_verdict_counts(spark, d):
    return online.replay(requests(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("r_eff"), 6).alias("mean_risk"))


@query()
def online_features_equal_batch(spark, d):
    """Features that the online path and the batch see otherwise, where nothing is denied: none. Counts that the state has pruned differ by 1e-5 at most."""
    live = online.replay(requests(spark, d), lambda f: 0.0)
    batch = history.spread_features(proxy.events(spark, d), counted=proxy.raw_events(spark, d))
    both = live.select("event_id", "features").join(batch.select("event_id", F.array(*M.FEATURES).alias("x")), "event_id")
    apart = F.zip_with("features", "x", lambda a, b: F.abs(a - b) > 1e-5 * (1 + F.abs(b)))
    wrong = F.filter(F.zip_with(apart, F.array(*map(F.lit, M.FEATURES)), lambda w, n: F.when(w, n)), lambda n: n.isNotNull())
    return both.agg(F.count("*").alias("rows"), F.count(F.when(F.size(wrong) > 0, 1)).alias("different"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(wrong)))).alias("features"))  # few distinct sets


@query()
def stepup_challenges(spark, d):
    """Challenges of decisions that ask for a step-up, answered after up to ten minutes, a fifth of them for another resource."""
    asked = online.replay(requests(spark, d)).where("verdict = 'STEPUP'").select("event_id")
    asked = requests(spark, d).join(asked, "event_id", "left_semi").select("event_id", "ts", "principal", "action", "resource")

    @F.pandas_udf("boolean")
    def answered(i: pd.Series, ts: pd.Series, p: pd.Series, a: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for n, t, *what in zip(i, ts, p, a, r, strict=True):
            now = t.timestamp()
            token = challenge.issue(SIGN, *what, now, str(n))
            out.append(challenge.valid(SIGN, token, what[0], what[1], what[2] + ("/other" if n % 5 == 0 else ""), now + n % 600))
        return pd.Series(out, dtype=bool)

    i = F.col("event_id")
    right = (i % 5 != 0) & (i % 600 < challenge.TTL_S)
    return asked.select("event_id", answered("event_id", "ts", "principal", "action", "resource").alias("valid"), right.alias("expected"))


@query()
def ledger_commit_counters(spark, d):
    """Records offered as a stream, some of them twice: what was committed, refused and left."""
    base = scratch(spark, "commit")
    r = chains(spark, d).withColumn("arrival", F.col("seq") * 2)
    again = r.where(F.col("seq") % 9 == 0).withColumn("arrival", F.col("arrival") + 1)
    offered = materialise(r.unionByName(again), "offered")
    offered.write.parquet(f"{base}/in")
    committer.commit(spark.readStream.schema(offered.schema).parquet(f"{base}/in"), f"{base}/ledger", f"{base}/checkpoint", SIGN).awaitTermination()
    return committer.counters(spark, f"{base}/ledger", offered)
