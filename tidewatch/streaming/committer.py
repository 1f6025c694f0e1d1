"""Records of a stream committed to a ledger: admitted batch by batch, what is refused kept beside it with the reason.

Beside the records lies an index: the ids that are taken and each chain's head, in buckets by hash. A
batch looks up the buckets that its own records fall into and no others, so it costs what it brings,
not what the ledger holds. Each batch adds a piece to the index; FAN pieces of one tier are merged
into one of the next, so a batch reads at most FAN - 1 pieces a tier, and which ones follows from its
number alone.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import model as M
from tidewatch.operators import ledger

REJECTED = "recId string, principal string, seq long, arrival long, reason string"
IDS, HEADS = "recId string, bucket int", "principal string, head_seq long, head_hash string, bucket int"
#: Buckets of the index, and pieces of a tier that make one of the next.
BUCKETS, FAN = 64, 16


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The batches written so far; none yet is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def committed(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, f"{path}/records", M.RECORD)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, f"{path}/rejected", REJECTED)


def heads(records: DataFrame) -> DataFrame:
    """principal, head_seq, head_hash of chains of records."""
    last = records.groupBy("principal").agg(F.max_by(F.struct(*[c for c in records.columns if c != "principal"]), "seq").alias("r")).select("principal", "r.*")
    return ledger.with_hash(last).select("principal", F.col("seq").alias("head_seq"), F.col("hash").alias("head_hash"))


# --- the index -------------------------------------------------------------------------------


def bucket_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def pieces(number: int) -> list[tuple[int, int]]:
    """(tier, first batch) of the index pieces that hold the batches before ``number``."""
    out, at, tier = [], 0, 0
    while FAN ** (tier + 1) <= number:
        tier += 1
    for t in range(tier, -1, -1):
        while at + FAN**t <= number:
            out.append((t, at))
            at += FAN**t
    return out


def _piece(path: str, kind: str, tier: int, first: int) -> str:
    return f"{path}/index/{kind}/tier={tier}/first={first}"


def _pieces(spark: SparkSession, path: str, kind: str, schema: str, which: list[tuple[int, int]]) -> DataFrame:
    if not which:
        return spark.createDataFrame([], schema)
    got = spark.read.schema(f"{schema}, tier int, first long").option("basePath", f"{path}/index/{kind}").parquet(*[_piece(path, kind, *p) for p in which])
    return got.drop("tier", "first")


def looked_up(spark: SparkSession, path: str, kind: str, schema: str, number: int, keys: DataFrame) -> DataFrame:
    """The index rows of the batches before ``number``, in the buckets of ``keys`` alone.

    ``keys`` has the key as its only column; the buckets are few, so they reach the driver.
    """
    key = keys.columns[0]
    touched = sorted(r[0] for r in keys.select(bucket_of(key)).distinct().collect())  # at most BUCKETS numbers
    there = pieces(number) if touched else []
    return _pieces(spark, path, kind, schema, there).where(F.col("bucket").isin(touched)).join(keys, key, "left_semi")


def latest(rows: DataFrame) -> DataFrame:
    """The furthest head of each principal."""
    return rows.groupBy("principal").agg(F.max_by(F.struct("head_seq", "head_hash", "bucket"), "head_seq").alias("h")).select("principal", "h.*")


def _indexed(spark: SparkSession, path: str, number: int, taken: DataFrame) -> None:
    """Add batch ``number``'s piece, and merge the tiers that it fills."""
    put = lambda rows, kind, tier, first: rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_piece(path, kind, tier, first))
    put(taken.select("recId", bucket_of("recId").alias("bucket")), "ids", 0, number)
    put(heads(taken).withColumn("bucket", bucket_of("principal")), "heads", 0, number)
    tier = 1
    while (number + 1) % FAN**tier == 0:
        first, step = number + 1 - FAN**tier, FAN ** (tier - 1)
        for kind, schema in (("ids", IDS), ("heads", HEADS)):
            rows = _pieces(spark, path, kind, schema, [(tier - 1, first + i * step) for i in range(FAN)])
            put(latest(rows).select("principal", "head_seq", "head_hash", "bucket") if kind == "heads" else rows, kind, tier, first)
        tier += 1


def ledger_heads(spark: SparkSession, path: str) -> DataFrame:
    """principal, head_seq, head_hash of every chain in the ledger, from the index."""
    rows = _pieces(spark, path, "heads", HEADS, pieces(_next_batch(spark, path)))
    return latest(rows).select("principal", "head_seq", "head_hash")


def _next_batch(spark: SparkSession, path: str) -> int:
    """One more than the last batch of the ledger; batches are written in order, so names alone tell."""
    fs, where = _fs(spark, f"{path}/done")
    if not fs.exists(where):
        return 0
    return max((int(f.getPath().getName()) + 1 for f in fs.listStatus(where)), default=0)


def _base(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The ledger's batch that the stream's batch 0 is: it stays while the checkpoint does, and a lost one starts behind what is there."""
    fs, note = _fs(spark, f"{path}/base/{zlib.crc32(checkpoint.encode())}")
    if _exists(spark, f"{checkpoint}/offsets") and fs.exists(note):
        text = fs.open(note)
        try:
            return text.readInt()
        finally:
            text.close()
    base = _next_batch(spark, path)
    out = fs.create(note, True)
    out.writeInt(base)
    out.close()
    return base


def commit(records: DataFrame, path: str, checkpoint: str, sign: ledger.Sign) -> StreamingQuery:
    """Commit a stream of records (RECORD and arrival) until it is used up.

    A batch goes to folders of its own number, overwritten when it is tried again: a restart after
    a failure neither loses nor doubles records. Without its checkpoint a stream goes on behind the
    batches that are there; what it offers again is refused. What is written is what was admitted,
    row for row: records that share id, principal and arrival are told apart.
    """
    base = _base(records.sparkSession, path, checkpoint)

    def one(batch: DataFrame, at: int) -> None:
        spark, number = batch.sparkSession, base + at
        batch = ledger.materialise(batch.select(*M.RECORD.names, "arrival"), "batch")
        known = looked_up(spark, path, "ids", IDS, number, batch.select("recId").where("recId is not null").distinct())
        begun = latest(looked_up(spark, path, "heads", HEADS, number, batch.select("principal").where("principal is not null").distinct()))
        said = ledger.materialise(ledger.judged(batch, sign, begun, known), "said")
        taken = said.where("reason = ''").select(*M.RECORD.names)
        taken.write.mode("overwrite").parquet(f"{path}/records/batch={number}")
        said.where("reason <> ''").select(*[c.split()[0] for c in REJECTED.split(", ")]).write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        _indexed(spark, path, number, spark.read.schema(M.RECORD).parquet(f"{path}/records/batch={number}"))
        fs, mark = _fs(spark, f"{path}/done/{number}")
        fs.create(mark, True).close()

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, path: str, offered: DataFrame) -> DataFrame:
    """committed, rejected, pending: one row; ``offered``: all records handed in so far."""
    n = lambda t, name: t.agg(F.count("*").alias(name))
    one = n(committed(spark, path), "committed").join(n(rejected(spark, path), "rejected")).join(n(offered, "offered"))  # single rows
    return one.select("committed", "rejected", (F.col("offered") - F.col("committed") - F.col("rejected")).alias("pending"))
