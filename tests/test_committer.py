"""The stream committer: what is committed is what was admitted; the index beside the ledger."""

import random

from pyspark.sql import functions as F

from tidewatch import model as M
from tidewatch.operators import ledger
from tidewatch.operators.linked import components
from tidewatch.streaming import committer

SIGN = ledger.keyed_mac(b"k")


def chains(spark, principals, n):
    rows = [(f"{p}-{i}", f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}", p, "a", "r", 0.5, 0.5, "ALLOW", "h") for p in principals for i in range(n)]
    d = spark.createDataFrame(rows, "recId string, ts string, principal string, action string, resource string, r double, r_eff double, verdict string, h_feat string")
    return ledger.materialise(ledger.chained(d, SIGN).withColumn("arrival", F.col("seq")), "chains")


def run(spark, base, schema, checkpoint="cp", files=None):
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files) if files else stream
    committer.commit(stream.parquet(f"{base}/in"), f"{base}/ledger", f"{base}/{checkpoint}", SIGN).awaitTermination()


def intact(spark, base):
    done = ledger.with_hash(committer.committed(spark, f"{base}/ledger"))
    return all(r["intact"] for r in ledger.verify(done, bad_signature=ledger.bad_signature(SIGN)).collect())


def test_forged_twins_are_never_committed(spark, tmp_path):
    base = f"file://{tmp_path}"
    r = chains(spark, [f"p{i}" for i in range(20)], 10)
    forged = r.withColumn("verdict", F.lit("ALLOW_FORGED"))
    offered = r.unionByName(forged).orderBy(F.rand(3))
    offered.repartition(5).write.parquet(f"{base}/in")
    run(spark, base, offered.schema)
    got = committer.committed(spark, f"{base}/ledger")
    assert got.count() == 200 and got.where("verdict = 'ALLOW_FORGED'").isEmpty() and got.where(ledger.bad_signature(SIGN)).isEmpty() and intact(spark, base)
    no = {x["reason"] for x in committer.rejected(spark, f"{base}/ledger").collect()}
    assert no <= {"signature does not verify", "duplicate recId"} and committer.counters(spark, f"{base}/ledger", offered).first()["rejected"] == 200


def test_batches_through_the_index_equal_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(committer, "FAN", 2)
    base, names = f"file://{tmp_path}", [f"p{i}" for i in range(6)]
    r = chains(spark, names, 14)
    again = r.where("seq % 5 = 0").withColumn("arrival", F.col("arrival") + 7)
    for step in range(7):
        r.unionByName(again).where(f"arrival div 3 = {step}").coalesce(1).write.mode("append").parquet(f"{base}/in")
        run(spark, base, r.schema)  # seven batches: tiers of 1, 2 and 4
    assert committer.committed(spark, f"{base}/ledger").count() == r.count() and intact(spark, base)
    heads = {x["principal"]: (x["head_seq"], x["head_hash"]) for x in committer.ledger_heads(spark, f"{base}/ledger").collect()}
    assert heads == {x["principal"]: (x["head_seq"], x["head_hash"]) for x in committer.heads(committer.committed(spark, f"{base}/ledger")).collect()}
    assert committer.rejected(spark, f"{base}/ledger").count() == again.count()


def test_pieces_hold_each_earlier_batch_once():
    for n in range(600):
        held = [b for tier, first in committer.pieces(n) for b in range(first, first + committer.FAN**tier)]
        assert held == list(range(n))
    assert len(committer.pieces(16**4 - 1)) == 4 * 15


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    base = f"file://{tmp_path}"
    r = chains(spark, [f"p{i}" for i in range(40)], 4)
    r.where("seq <= 3").write.parquet(f"{base}/in")
    run(spark, base, r.schema)
    keys = r.where("seq = 4 and principal in ('p1', 'p2')").select("principal")
    found = committer.looked_up(spark, f"{base}/ledger", "heads", committer.HEADS, 1, keys)
    touched = {x[0] for x in keys.select(committer.bucket_of("principal")).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and {x["principal"] for x in found.collect()} == {"p1", "p2"}
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in found.inputFiles() if "bucket=" in f}
    assert len(files) > 20 and 1 <= len(touched) <= 2


def test_without_its_checkpoint_a_stream_goes_on_behind_what_is_there(spark, tmp_path):
    base = f"file://{tmp_path}"
    r = chains(spark, ["p", "q"], 6)
    r.where("seq <= 3").write.parquet(f"{base}/in")
    run(spark, base, r.schema, "one")
    r.where("seq > 3").write.mode("append").parquet(f"{base}/in")
    run(spark, base, r.schema, "two")  # reads everything again
    assert committer.committed(spark, f"{base}/ledger").count() == 12 and intact(spark, base)
    assert {x["reason"] for x in committer.rejected(spark, f"{base}/ledger").collect()} == {"duplicate recId"}
    run(spark, base, r.schema, "two")
    assert committer.committed(spark, f"{base}/ledger").count() == 12


def test_many_shared_ids_are_decided_in_one_fold(spark):
    from tests.test_operators import brute_admission

    random.seed(8)
    rows = []
    for n in range(160):
        p = random.choice("pqrstu") + str(n % 7)
        r = {"recId": f"r{random.randint(0, 60)}", "prevHash": M.GENESIS, "seq": random.choice([1, 1, 1, 2]), "ts": "t", "principal": p, "action": "a", "resource": "x", "r": 0.5, "r_eff": 0.5, "verdict": "ALLOW", "h_feat": "h", "sig": None}
        r["sig"] = SIGN(ledger.canonical(r))
        rows.append(r | {"arrival": n})
    names = [*M.RECORD.names, "arrival"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in M.RECORD.fields) + ", arrival long"
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema).repartition(4)
    got = [r["reason"] for r in ledger.admit(df, SIGN).orderBy("arrival").collect()]
    assert got == brute_admission(rows)


def test_components(spark):
    random.seed(1)
    links = [(f"n{random.randint(0, 80)}", f"n{random.randint(0, 80)}") for _ in range(50)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("z", "z")]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}
