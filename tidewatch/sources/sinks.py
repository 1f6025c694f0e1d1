"""Report sinks, and the append-only ledger as JSON lines."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tidewatch import model as M


def write_report(table: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one file: csv with a header, or json lines."""
    out = table.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written there where it isn't yet. A write that broke off leaves no marker and is made anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def install_key(spark: SparkSession, path: str, key_id: str, fingerprint: str) -> None:
    """Write the verifier's key once; a second time is an error, whatever the key."""
    spark.createDataFrame([(key_id, fingerprint)], "key_id string, fingerprint string").coalesce(1).write.mode("errorifexists").json(path)


def append_ledger(records: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Records appended as JSON lines: a batch at once, a stream until it is used up."""
    if not records.isStreaming:
        records.write.mode("append").json(path)
        return None
    return records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's records; r and r_eff differ by more than case there too."""
    return spark.read.schema(M.RECORD).json(path)


def write_ordered(events: DataFrame, path: str) -> None:
    """The events of all sources in one order, (ts, event_id): each file is in order and ends before the next begins.

    One exchange by ranges, then each part is sorted for itself; the names of the files follow the order.
    """
    events.orderBy("ts", "event_id").write.parquet(path)


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_ordered`` wrote, with place: from 1, in the one order over all files.

    A row's place is its place in its file and the rows of the files before, known from a count a file; there is no
    exchange of rows and no task that sees them all.
    """
    rows = spark.read.parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")})
    part = lambda pattern: F.regexp_extract("_file", pattern, 1).cast("long")
    sizes = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("_file")).groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy(part(r"^part-(\d+)"), part(r"-c(\d+)\.[^-]*$")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_file", before.alias("_before"))  # one row a file
    return rows.join(F.broadcast(offsets), "_file").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before")


POSTED = "recId string, principal string, seq long, status int, reason string"


def posted(records: DataFrame, url: str, *, tries: int = 3, wait_s: float = 1.5, timeout_s: float = 150.0) -> DataFrame:
    """recId, principal, seq, status, reason: each record (RECORD) sent to a ledger's HTTP service, a chain's in order of seq.

    A refusal (422) is an answer, with its reason; other failures are tried again, ``tries`` times in all, after
    rising waits, and then end the task, so that Spark tries it anew. The service knows a record by its recId.
    """
    names = [c.split()[0] for c in POSTED.split(", ")]

    def send(record: dict) -> tuple[int, str]:
        body = json.dumps({"record": record}).encode()
        for n in range(tries):
            try:
                request = urllib.request.Request(f"{url.rstrip('/')}/LogAccess", data=body, headers={"content-type": "application/json"}, method="POST")
                with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                    return answer.status, ""
            except urllib.error.HTTPError as e:
                said = e.read().decode(errors="replace")
                if e.code == 422:
                    return 422, said
                last = f"HTTP {e.code}: {said}"
            except OSError as e:
                last = str(e)
            time.sleep(wait_s * (n + 1) if n + 1 < tries else 0)
        raise RuntimeError(f"the ledger does not take {record['recId']}: {last}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            yield pd.DataFrame([(r["recId"], r["principal"], r["seq"], *send(r)) for r in rows], columns=names)

    own = records.select(*M.RECORD.names).repartition("principal").sortWithinPartitions("principal", "seq", "recId")
    return own.mapInPandas(run, POSTED)


def post_ledger(records: DataFrame, url: str, path: str, checkpoint: str, **how) -> StreamingQuery:
    """A stream of records sent to a ledger's service until it is used up; what it said goes to ``path``, a folder a batch.

    A batch's answers are written as a whole or not at all; a batch that fails is sent again.
    """

    def one(batch: DataFrame, number: int) -> None:
        posted(batch, url, **how).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
