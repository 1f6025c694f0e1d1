import pytest
from pyspark.sql import functions as F

from tidewatch import model as M
from tidewatch.operators import rollup
from tidewatch.sources import activity, sinks

ID = "{{A{0:03d}-BBBBBBBB-CCCCCCCC}}"


@pytest.fixture
def raw(tmp_path):
    def put(name, header, rows):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join([",".join(header)] * bool(header) + rows) + "\n")

    put("logon.csv", M.HEADERS["logon"], [f"{ID.format(1)},01/02/2010 07:11:03,U1,PC-1,Logon", f"{ID.format(2)},01/02/2010 17:00:00,U1,PC-1,Logoff", f"{ID.format(3)},not a time,U1,PC-1,Logon", "too,few"])
    put("device.csv", M.HEADERS["device"], [f"{ID.format(1)},01/03/2010 08:00:00,U2,PC-2,Connect"])
    put("file.csv", M.HEADERS["file"], [f"{ID.format(5)},01/04/2010 08:00:00,U1,PC-1,\\a\\b.txt,hello"])
    put("http.csv", M.HEADERS["http"], [f"{ID.format(6)},02/05/2010 08:00:00,U1,PC-1,http://www.Site.com/x/y,abc", f"{ID.format(7)},02/05/2010 08:00:00,U9,,plain host,"])
    put("LDAP/2010-01.csv", M.ORG_HEADER, ["n,U1,e,Clerk,B,1 - Research,D,T,S", "n,U2,e,Clerk,Sales,,D,T,"])
    put("LDAP/2010-02.csv", M.ORG_HEADER, ["n,U1,e,ITAdmin,B,2 - Labs,D,T,S"])
    put("answers/r4.2-2/r4.2-2-U1.csv", (), [f"logon,{ID.format(2)},01/02/2010 17:00:00,U1,PC-1,Logoff"])
    put("answers/r4.2-3/r4.2-3-U2.csv", (), [f"see {ID.format(6)} there"])
    put("answers/r5.2-1/r5.2-1-U3.csv", (), [f"logon,{ID.format(1)},x,U1"])
    put("answers/insiders.csv", ("dataset", "scenario", "details", "user", "start", "end"), ["4.2,1,x,U1,a,b", "r4.2,1,x,U2,a,b", "5.2,1,x,U3,a,b"])
    return str(tmp_path)


def test_org_takes_the_last_snapshot(spark, raw):
    o = {r["principal"]: r for r in activity.org_units(spark, f"{raw}/LDAP").collect()}
    assert (o["U1"]["role"], o["U1"]["unit_bucket"], o["U1"]["first_seen"]) == ("ITAdmin", "org-2-labs", "2010-02")
    assert o["U2"]["unit_bucket"] == "org-sales"


def test_labels_and_roster(spark, raw):
    got = {(r["source"], r["event_id"], r["scenario"]) for r in activity.labels(spark, f"{raw}/answers", "4.2").collect()}
    assert got == {("logon", ID.format(2), "r4.2-2"), ("", ID.format(6), "r4.2-3")}
    assert {r["user"] for r in activity.insiders(spark, f"{raw}/answers/insiders.csv", "4.2").collect()} == {"U1", "U2"}


def test_events_are_mapped_labelled_and_bad_rows_skipped(spark, raw):
    org, known = activity.org_units(spark, f"{raw}/LDAP"), activity.labels(spark, f"{raw}/answers", "4.2")
    e = activity.events(spark, raw, org, known)
    assert [f.name for f in e.schema] == [f.name for f in M.EVENT]
    got = {(r["source"], r["event_id"]): r for r in e.collect()}
    assert len(got) == 6
    a = got["logon", ID.format(1)]
    assert (a["action"], a["resource"], a["label"], a["egress"]) == ("sts:AssumeRole", activity.ROLE_ARN + "org-2-labs-session", 0, False)
    assert got["logon", ID.format(2)]["label"] == 1 and got["device", ID.format(1)]["label"] == 0 and got["http", ID.format(6)]["label"] == 1
    assert got["device", ID.format(1)]["resource"] == "arn:aws:s3:::org-sales/removable/PC-2"
    f = got["file", ID.format(5)]
    assert (f["resource"], f["bytes_read"], f["egress"]) == ("arn:aws:s3:::org-2-labs/removable/a/b.txt", 5, True)
    assert got["http", ID.format(6)]["resource"] == "arn:aws:execute-api:::www-site-com"
    assert got["http", ID.format(7)]["resource"] == "arn:aws:execute-api:::plain-host" and got["http", ID.format(7)]["pc"] == ""
    assert activity.events(spark, raw, org, known, until="2010-01-31").count() == 4


def test_a_wrong_header_fails(spark, raw, tmp_path):
    (tmp_path / "bad.csv").write_text("id,user,date,pc,activity\nx,y,z,a,b\n")
    with pytest.raises(activity.HeaderError):
        activity.read_csv(spark, f"{raw}/bad.csv", M.HEADERS["logon"])


def test_splits_are_disjoint_in_time_and_written_even_if_empty(spark, tmp_path):
    rows = spark.range(100).select("id", F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ts"), (F.col("id") == 3).cast("int").alias("label"))
    split = rollup.routed(rollup.time_split(F.col("ts"), "2024-01-01 00:00:00", (50.0, 20.0)), F.col("label"))
    activity.write_splits(rows, split, str(tmp_path / "s"))
    got = {n: [r["id"] for r in spark.read.parquet(f"{tmp_path}/s/{n}").orderBy("id").collect()] for n in ("train", "train_malicious", "val", "test")}
    assert got == {"train": [i for i in range(50) if i != 3], "train_malicious": [3], "val": list(range(50, 70)), "test": list(range(70, 100))}
    activity.write_splits(rows.limit(0), split, str(tmp_path / "e"))
    assert spark.read.parquet(f"{tmp_path}/e/val").count() == 0


def test_records_follow_quotes_over_lines_and_splits(spark, tmp_path):
    """Against the csv module, with splits of every small size."""
    import csv
    import io
    import random

    random.seed(6)
    cell = lambda: random.choice(["", "a", "b c", 'say "so"', "x,y", "two\nlines", "\n", 'end"', '",\n"', "ü", "5\" disk"])
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(M.HEADERS["logon"])
    rows = [[f"id{i}", cell(), cell(), cell(), cell()] for i in range(120)]
    w.writerows(rows)
    text = out.getvalue() + "too,few\n" + 'id-s,a,5" disk,b,c\n' + '"many",1,2,3,4,5\nlast,1,2,3,4'
    rows += [["id-s", "a", '5" disk', "b", "c"], ["last", "1", "2", "3", "4"]]
    (tmp_path / "x.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "400", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = sorted(tuple(x or "" for x in r) for r in activity.read_csv(spark, f"{tmp_path}/x.csv", M.HEADERS["logon"]).drop("_file").collect())
            assert got == sorted(tuple(r) for r in rows), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_wrong_header_of_many_files(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text(",".join(M.HEADERS["logon"]) + "\nx,y,z,a,b\n")
    (tmp_path / "3.csv").write_text("id,date,user,activity,pc\n" + "x,y,z,a,b\n" * 10_000)
    with pytest.raises(activity.HeaderError, match="3.csv"):
        activity.check_header(spark, str(tmp_path), M.HEADERS["logon"])
    (tmp_path / "3.csv").write_text("")
    assert activity.read_csv(spark, str(tmp_path), M.HEADERS["logon"]).count() == 3


def test_events_are_written_in_one_order(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rows = spark.range(5000).select(F.timestamp_add("SECOND", (F.col("id") * 7919 % 3001).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ts"), F.col("id").alias("event_id")).repartition(6)
    plan = rows.orderBy("ts", "event_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1
    sinks.write_ordered(rows, f"{tmp_path}/o")
    got = [(r["ts"], r["event_id"]) for f in sorted(glob.glob(f"{tmp_path}/o/part-*")) for r in pq.ParquetFile(f).read().to_pylist()]
    assert len(got) == 5000 and got == sorted(got)


def test_records_are_posted_with_retries_and_refusals_kept(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    tries, taken, lock = {}, [], threading.Lock()

    class Ledger(BaseHTTPRequestHandler):
        def do_POST(self):
            record = json.loads(self.rfile.read(int(self.headers["content-length"])))["record"]
            with lock:
                tries[record["recId"]] = tries.get(record["recId"], 0) + 1
                code = 500 if record["recId"] == "p-1" and tries["p-1"] < 3 else 422 if record["recId"] == "q-2" else 200
                if code == 200:
                    taken.append((record["principal"], record["seq"]))
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"seq discontinuity" if code == 422 else b"null")

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Ledger)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = [(f"{p}-{i}", "0" * 64, i, "t", p, "a", "r", 0.5, 0.5, "ALLOW", "h", "s") for p in "pq" for i in range(1, 6)]
        spark.createDataFrame(rows, M.RECORD).repartition(3).write.parquet(f"{tmp_path}/in")
        how = {"wait_s": 0.01, "timeout_s": 5.0}
        url = f"http://127.0.0.1:{server.server_port}"
        stream = spark.readStream.schema(M.RECORD).parquet(f"{tmp_path}/in")
        sinks.post_ledger(stream, url, f"{tmp_path}/out", f"{tmp_path}/cp", **how).awaitTermination()
        got = {r["recId"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert len(got) == 10 and tries["p-1"] == 3 and (got["q-2"]["status"], got["q-2"]["reason"]) == (422, "seq discontinuity")
        assert [s for p, s in taken if p == "p"] == [1, 2, 3, 4, 5] and got["p-1"]["status"] == 200
    finally:
        server.shutdown()
    with pytest.raises(Exception, match="does not take"):
        sinks.posted(spark.createDataFrame(rows[:1], M.RECORD), url, **how).collect()
