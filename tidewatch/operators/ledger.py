"""Decision records in hash chains, one chain a principal: canonical bytes, hashes, checks, tampering.

Building a chain is sequential within a principal; checking is not: each place needs only its
own record and its predecessor's hash, so all chains are verified with one window pass.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch import model as M
from tidewatch.operators.linked import components
from tidewatch.session import materialise

# The signed fields.
SIGNED = ("recId", "prevHash", "seq", "ts", "principal", "action", "resource", "r", "R", "verdict", "h_feat")
Sign = Callable[[bytes], str]


def canonical(record: dict) -> bytes:
    """The signed fields as sorted compact ASCII JSON, floats rounded to 8 places."""
    flat = {k: record.get("r_eff" if k == "R" and "R" not in record else k) for k in SIGNED}
    for k, v in flat.items():
        if isinstance(v, float):
            flat[k] = None if v != v else round(v, 8)
    if flat["seq"] is not None:
        flat["seq"] = int(flat["seq"])
    return json.dumps(flat, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()


def record_hash(record: dict) -> str:
    return hashlib.sha256(canonical(record) + (record.get("sig") or "").encode()).hexdigest()


def keyed_mac(key: bytes) -> Sign:
    """HMAC-SHA256 over the canonical bytes: a stand-in for a signature, not one."""
    return lambda data: hmac.new(key, data, hashlib.sha256).hexdigest()


@F.pandas_udf(M.S)
def canonical_text(rows: pd.DataFrame) -> pd.Series:
    """Canonical bytes (ASCII) of a struct of the record's columns."""
    return pd.Series([canonical(r).decode() for r in rows.astype(object).where(rows.notna(), None).to_dict("records")], dtype=object)


def feature_digest(features: Column, salt: Column) -> Column:
    """sha256 of the features as little-endian 32-bit floats, then the salt; null features: the salt alone."""

    @F.pandas_udf(M.S)
    def digest(x: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256((b"" if v is None else np.asarray(v, "<f4").tobytes()) + (bytes(b) if b is not None else b"")).hexdigest() for v, b in zip(x, s, strict=True)])

    return digest(features, salt)


def signed_fields() -> Column:
    return F.struct(*[F.col(c) for c in ("recId", "prevHash", "seq", "ts", "principal", "action", "resource", "r", "r_eff", "verdict", "h_feat")])


def bad_signature(sign: Sign) -> Column:
    """Whether a record's sig is not what ``sign`` gives over its canonical bytes."""

    @F.pandas_udf("boolean")
    def bad(rows: pd.DataFrame, sig: pd.Series) -> pd.Series:
        records = rows.astype(object).where(rows.notna(), None).to_dict("records")
        return pd.Series([s != sign(canonical(r)) for r, s in zip(records, sig, strict=True)], dtype=bool)

    return bad(signed_fields(), F.col("sig"))


def with_hash(records: DataFrame) -> DataFrame:
    """Adds hash: sha256 of canonical bytes and sig."""
    fields = signed_fields()
    return records.withColumn("hash", F.sha2(F.concat(canonical_text(fields), F.coalesce("sig", F.lit(""))), 256))


def chained(decisions: DataFrame, sign: Sign) -> DataFrame:
    """Records with seq, prevHash and sig, in (ts, recId) order within each principal.

    The fold is over a principal's own rows, in batches, so that a long chain is never held whole.
    """
    schema = M.RECORD

    def fold(batches):
        head: dict[str, tuple[int, str]] = {}
        for pdf in batches:
            rows = []
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                seq, prev = head.get(r["principal"], (0, M.GENESIS))
                r |= {"seq": seq + 1, "prevHash": prev}
                r["sig"] = sign(canonical(r))
                head = {r["principal"]: (seq + 1, record_hash(r))}
                rows.append(r)
            yield pd.DataFrame(rows, columns=schema.names)

    cols = [F.col(c) for c in ("recId", "ts", "principal", "action", "resource", "r", "r_eff", "verdict", "h_feat")]
    blank = [F.lit(None).cast("string").alias("prevHash"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("sig")]
    ordered = decisions.select(*cols, *blank).repartition("principal").sortWithinPartitions("principal", "ts", "recId")
    return ordered.mapInPandas(fold, schema)


def verify(hashed: DataFrame, heads: DataFrame | None = None, bad_signature: Column | None = None) -> DataFrame:
    """principal, records, intact, first_discontinuity (-1: none), over records with their hash.

    ``heads`` (principal, head_seq) says how long each chain must be.
    """
    order = Window.partitionBy("principal").orderBy("seq", "recId")
    pos = F.row_number().over(order) - 1
    prev = F.coalesce(F.lag("hash").over(order), F.lit(M.GENESIS))
    r = hashed.select("principal", pos.alias("pos"), "seq", "prevHash", prev.alias("_prev"), (bad_signature if bad_signature is not None else F.lit(False)).alias("_bad"))
    broken = (F.col("seq") != F.col("pos") + 1) | (F.col("prevHash") != F.col("_prev")) | F.col("_bad")
    out = r.groupBy("principal").agg(F.count("*").alias("records"), F.min(F.when(F.coalesce(broken, F.lit(True)), F.col("pos"))).alias("_at"))
    if heads is not None:
        out = out.join(heads.select("principal", "head_seq"), "principal", "full").withColumn("records", F.coalesce("records", F.lit(0).cast("long")))
        out = out.withColumn("_at", F.coalesce("_at", F.when(F.col("head_seq") != F.col("records"), F.col("records"))))
    at = F.coalesce(F.col("_at").cast("long"), F.lit(-1).cast("long"))
    return out.select("principal", "records", (at == -1).alias("intact"), at.alias("first_discontinuity"))


def tamper_table(done: DataFrame, verdicts: DataFrame) -> DataFrame:
    """kind (with a row "total"), attempts, succeeded, detected.

    ``done``: principal, seq, kind, succeeded (the ledger holds the change), a row an attempt; ``verdicts``: as of ``verify``.
    An attempt is detected if it succeeded and its chain breaks at its place or before; later ones alone don't count.
    """
    at = verdicts.select("principal", F.col("first_discontinuity").alias("_at"))
    found = F.coalesce(F.col("_at").between(0, F.col("seq") - 1), F.lit(False))
    t = done.join(at, "principal", "left").select("kind", "succeeded", (F.col("succeeded") & found).alias("found"))
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long"))
    out = t.rollup("kind").agg(F.grouping("kind").alias("_all"), F.count("*").alias("attempts"), n("succeeded").alias("succeeded"), n("found").alias("detected"))
    return out.withColumn("kind", F.when(F.col("_all") == 1, "total").otherwise(F.col("kind"))).drop("_all")


def judged(records: DataFrame, sign: Sign, heads: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The records (RECORD and arrival) with reason: what a ledger says to them, offered in order of (arrival, principal, recId).

    Checks in order: ids present, recId among the accepted records of any principal, signature, seq
    after the head, prevHash of it. ``heads`` (principal, head_seq, head_hash) and ``known`` (recId) are what
    the ledger holds already. Records that agree in the order are told apart by their content, so the
    result doesn't depend on how rows arrive.

    Principals that share a recId are decided together: the components of such principals, found in
    rounds of joins, are folded in arrival order, one fold each. Other principals are components of their own.
    """
    spark = records.sparkSession
    rows = records.select(*M.RECORD.names, "arrival")
    uses = rows.where("recId is not null").groupBy("recId").agg(F.count("*").alias("_n"), F.min("principal").alias("_least"), F.max("principal").alias("_most")).where("_n > 1")
    uses = materialise(uses, "uses")
    shared = uses.where("_least <> _most").select("recId", "_least")
    none = shared.isEmpty()
    group = F.col("principal")
    rows = rows.join(uses.select("recId", F.lit(True).alias("_again")), "recId", "left")
    if not none:
        links = rows.join(shared, "recId").where("principal is not null").select(F.col("principal").alias("a"), F.col("_least").alias("b")).distinct()
        rows = rows.join(components(links).withColumnRenamed("node", "principal"), "principal", "left")
        group = F.coalesce("component", "principal")
    rows = rows.join(known.select("recId").distinct().withColumn("_held", F.lit(True)), "recId", "left") if known is not None else rows.withColumn("_held", F.lit(None).cast("boolean"))
    start = heads.select("principal", "head_seq", "head_hash") if heads is not None else spark.createDataFrame([], "principal string, head_seq long, head_hash string")
    rows = rows.join(start, "principal", "left").withColumn("_group", group)
    schema = T.StructType([*M.RECORD.fields, T.StructField("arrival", T.LongType()), T.StructField("reason", T.StringType())])

    def fold(batches):
        which, head, seen = None, {}, set()
        for pdf in batches:
            out = []
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if r["_group"] != which:
                    which, head, seen = r["_group"], {}, set()
                seq, last = head.get(r["principal"]) or ((int(r["head_seq"]), r["head_hash"]) if r["head_seq"] is not None else (0, M.GENESIS))
                if not r["recId"] or not r["principal"]:
                    why = "recId and principal are required"
                elif r["_held"] or r["recId"] in seen:
                    why = "duplicate recId"
                elif r["sig"] != sign(canonical(r)):
                    why = "signature does not verify"
                elif r["seq"] != seq + 1:
                    why = "seq discontinuity"
                elif r["prevHash"] != last:
                    why = "prevHash mismatch"
                else:
                    why = ""
                    if r["_again"]:  # only ids that come again need remembering
                        seen.add(r["recId"])
                    head[r["principal"]] = (int(r["seq"]), record_hash(r))
                out.append((*(r[c] for c in M.RECORD.names), r["arrival"], why))
            yield pd.DataFrame(out, columns=schema.names)

    ordered = rows.repartition("_group").sortWithinPartitions("_group", "arrival", "principal", "recId", "sig", "seq", "prevHash", *[c for c in M.RECORD.names if c not in ("principal", "recId", "sig", "seq", "prevHash")])
    return ordered.select(*M.RECORD.names, "arrival", "_group", "_again", "_held", "head_seq", "head_hash").mapInPandas(fold, schema)


def admit(records: DataFrame, sign: Sign, heads: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """recId, principal, seq, arrival, reason of ``judged``."""
    return judged(records, sign, heads, known).select("recId", "principal", "seq", "arrival", "reason")


def tamper(records: DataFrame, kind: str, victims: Column) -> DataFrame:
    """``records`` with the victims deleted, modified, backdated, or doubled by a fabricated record."""
    if kind == "delete":
        return records.where(~victims)
    if kind == "modify":
        return records.withColumn("verdict", F.when(victims, "ALLOW_FORGED").otherwise(F.col("verdict")))
    if kind == "backdate":
        return records.withColumn("ts", F.when(victims, "1999-01-01T00:00:00").otherwise(F.col("ts")))
    if kind == "fabricate":
        return records.union(records.where(victims).withColumn("recId", F.concat(F.lit("forged-"), "recId")).select(*records.columns))
    raise ValueError(f"unknown kind {kind!r}")


def recheck(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """recId, matches: whether the evidence's features and salt give the record's digest; null where none is kept."""
    both = records.select("recId", "h_feat").join(evidence.select("recId", "x", "salt"), "recId", "left")
    return both.select("recId", F.when(F.col("salt").isNotNull(), F.col("h_feat") == feature_digest(F.col("x"), F.col("salt"))).alias("matches"))
