"""Readers of raw activity files, organisation snapshots and label trees, and the canonical mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch import model as M
from tidewatch.functions import columns as C

ROLE_ARN = "arn:aws:iam::000000000000:role/"
# What an event id looks like, strictly and loosely.
EVENT_ID = r"\{[A-Z0-9]{4}-[A-Z0-9]{8}-[A-Z0-9]{8}\}"
LOOSE_ID = r"\{[A-Z0-9-]{8,}\}"


class HeaderError(ValueError):
    """A file's header is not the declared one."""


def check_header(spark: SparkSession, path: str, expected: tuple[str, ...]) -> None:
    """The first line of every file under ``path`` must be ``expected``, in order; no more of a file is read for it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in spark.read.text(path).inputFiles():
        where = jvm.org.apache.hadoop.fs.Path(name)
        stream = where.getFileSystem(conf).open(where)
        try:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"), 8192)
            line = reader.readLine()
        finally:
            stream.close()
        if line is None:
            continue
        got = tuple(x.strip(' "\ufeff\r') for x in line.split(","))
        if got != expected:
            raise HeaderError(f"{name}: header {line!r}, expected {','.join(expected)!r}")


# A quoted field, closed or not: a doubled quote stands for one. Fields begin at a line's start or after a comma.
_INSIDE = '(?:[^"]++|"")*+'
_FIELD = f'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'
_OPENS = f'(?:{_FIELD},)*+"{_INSIDE}$'


def records(lines: DataFrame) -> DataFrame:
    """f, value: the records of lines (f, b, i, value), which a quoted field may carry over several.

    ``f`` is the file, ``b`` where the split begins, ``i`` rises within it. Whether a line begins within quotes
    depends on all lines before it, but each line does one of four things to that state: it leaves it, turns
    it, opens or closes. So each split's lines are summed up for both states, the splits' sums
    are followed through a file, and then each split knows where it stands.
    """
    x = lines.withColumn("_e0", F.col("value").rlike(f"^{_OPENS}").cast("int"))
    x = x.withColumn("_e1", (F.col("value").rlike(f"^{_INSIDE}$") | F.col("value").rlike(f'^{_INSIDE}"[^,]*+,{_OPENS}')).cast("int"))
    fixed = F.col("_e0") == F.col("_e1")
    turns = ((F.col("_e0") == 1) & (F.col("_e1") == 0)).cast("int")
    own = Window.partitionBy("f", "b").orderBy("i")
    upto, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_turns", F.sum(turns).over(upto))
    mark = F.when(fixed, F.struct(F.col("_e0").alias("state"), F.col("_turns").alias("at")))
    x = x.withColumn("_mark", F.last(mark, ignorenulls=True).over(ahead)).withColumn("_before", F.coalesce(F.lag("_turns").over(own), F.lit(0)))
    # a split's effect: a state, or turns of the state that it begins with
    whole = x.groupBy("f", "b").agg(F.max_by(F.struct("_turns", F.coalesce(mark, F.col("_mark")).alias("mark")), "i").alias("end"))
    whole = whole.select("f", "b", F.when(F.col("end.mark").isNotNull(), (F.col("end.mark.state") + F.col("end._turns") - F.col("end.mark.at")) % 2).alias("_state"), F.col("end._turns").alias("_n"))
    files = Window.partitionBy("f").orderBy("b")  # a row a split
    total = F.sum("_n").over(files.rowsBetween(Window.unboundedPreceding, 0))
    whole = whole.withColumn("_total", total)
    last = F.last(F.when(F.col("_state").isNotNull(), F.struct("_state", "_total")), ignorenulls=True).over(files.rowsBetween(Window.unboundedPreceding, -1))
    begin = F.coalesce((F.col("_last._state") + F.col("_total") - F.col("_n") - F.col("_last._total")) % 2, (F.col("_total") - F.col("_n")) % 2)
    whole = whole.withColumn("_last", last).select("f", "b", begin.alias("_begin"))
    x = x.join(whole, ["f", "b"])
    inside = F.coalesce((F.col("_mark.state") + F.col("_before") - F.col("_mark.at")) % 2, (F.col("_begin") + F.col("_before")) % 2)
    x = x.withColumn("_in", inside).withColumn("_out", F.when(F.col("_in") == 1, F.col("_e1")).otherwise(F.col("_e0")))
    alone = x.where("_in = 0 and _out = 0").select("f", "value")
    # lines of a record have its first line's place; one that began in an earlier split has that of the last record begun there
    x = x.where("_in = 1 or _out = 1")
    first = F.when(F.col("_in") == 0, F.struct("b", "i"))
    x = x.withColumn("_first", F.last(first, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    heads = x.groupBy("f", "b").agg(F.max(first).alias("_open"))
    heads = heads.select("f", "b", F.last("_open", ignorenulls=True).over(files.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    x = x.join(heads, ["f", "b"]).withColumn("_first", F.coalesce("_first", "_carried"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "i", "value"))), lambda y: y["value"]), "\n")
    return alone.unionByName(x.groupBy("f", "_first").agg(text.alias("value")).select("f", "value"))


def read_csv(spark: SparkSession, path: str, header: tuple[str, ...], *, checked: bool = True) -> DataFrame:
    """All columns as strings; rows with another number of fields are skipped. A quoted field may hold line breaks, across splits too."""
    if checked:
        check_header(spark, path, header)
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header] + [T.StructField("_corrupt", T.StringType())])
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    top = F.min("i").over(Window.partitionBy("f", "b"))  # the exchange that records makes serves this too
    lines = lines.withColumn("_top", top).where((F.col("b") > 0) | (F.col("i") > F.col("_top"))).drop("_top")
    rows = records(lines).where("value <> ''").select(F.from_csv(F.rtrim(F.col("value"), F.lit("\r")), schema.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"}).alias("r"), "f")
    return rows.where("r is not null and r._corrupt is null").select(*[F.col(f"r.`{h}`") for h in header], F.col("f").alias("_file"))


def parsed_time(text: Column) -> Column:
    """Time without zone; null where it doesn't parse."""
    return F.try_to_timestamp(F.trim(text), F.lit(M.TIME_FORMAT)).cast("timestamp_ntz")


def org_units(spark: SparkSession, path: str) -> DataFrame:
    """One row a user, from the latest snapshot (files are named by month)."""
    rows = read_csv(spark, path, M.ORG_HEADER).withColumn("first_seen", F.regexp_extract("_file", r"([^/]+)\.csv$", 1))
    cols = [c for c in M.ORG_HEADER if c not in ("user_id", "employee_name", "email")]
    last = rows.groupBy("user_id").agg(F.max_by(F.struct(*cols, "first_seen"), "first_seen").alias("o"))
    return last.select(F.col("user_id").alias("principal"), "o.*", C.bucket(F.coalesce("o.functional_unit", F.lit("")), F.coalesce("o.business_unit", F.lit(""))).alias("unit_bucket"))


def labels(spark: SparkSession, path: str, release: str) -> DataFrame:
    """source, event_id, scenario of the release's files; a file without well-formed rows gives its ids with an empty source."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"r{release}-*.csv").text(path).select(F.input_file_name().alias("file"), "value")
    part = F.split("value", ",")
    rows = rows.select("file", "value", F.lower(F.trim(part[0])).alias("source"), F.trim(F.get(part, F.lit(1))).alias("id"))
    scenario = F.regexp_extract("file", r"([^/]+)/[^/]+\.csv$", 1)
    strict = rows.where(F.col("id").rlike(f"^{EVENT_ID}$")).select("file", "source", F.col("id").alias("event_id"))
    plain = rows.join(strict.select("file").distinct(), "file", "left_anti")
    found = lambda p: F.expr(f"regexp_extract_all(value, r'{p}', 0)")
    ids = plain.select("file", F.when(F.size(found(EVENT_ID)) > 0, found(EVENT_ID)).otherwise(found(LOOSE_ID)).alias("ids"))
    loose = ids.select("file", F.lit("").alias("source"), F.explode("ids").alias("event_id"))
    return strict.unionByName(loose).withColumn("scenario", scenario).groupBy("source", "event_id").agg(F.min("scenario").alias("scenario"))


def insiders(spark: SparkSession, path: str, release: str) -> DataFrame:
    """Users of the roster for the release; a roster without a dataset column is taken whole."""
    t = spark.read.csv(path, header=True)
    t = t.toDF(*[c.strip().lower() for c in t.columns])
    if "dataset" in t.columns:
        t = t.where(F.trim("dataset").isin(release, f"r{release}"))
    return t.select(F.trim("user").alias("user")).where("user <> ''").distinct()


def _event(rows: DataFrame, source: str, bucket: Column) -> DataFrame:
    """One source's rows as canonical events."""
    col = F.col
    none = F.lit(0).cast("long")
    if source == "logon":
        logon = F.lower(F.trim("activity")) == "logon"
        action, resource = F.when(logon, "sts:AssumeRole").otherwise("sts:SessionEnd"), F.concat(F.lit(ROLE_ARN), C.slug(bucket), F.lit("-session"))
        size, extra, out = none, F.create_map(F.lit("activity"), col("activity")), F.lit(False)
    elif source == "device":
        action, resource = F.lit("s3:GetObject"), F.concat(F.lit("arn:aws:s3:::"), bucket, F.lit("/removable/"), col("pc"))
        size, extra, out = none, F.create_map(F.lit("activity"), col("activity")), F.lit(True)
    elif source == "file":
        key = F.ltrim(F.replace(F.trim("filename"), F.lit("\\"), F.lit("/")), F.lit("/"))
        action, resource = F.lit("s3:GetObject"), F.concat(F.lit("arn:aws:s3:::"), bucket, F.lit("/removable/"), key)
        size, extra, out = F.length(F.coalesce("content", F.lit(""))).cast("long"), F.create_map(F.lit("filename"), F.trim("filename")), F.lit(True)
    elif source == "http":
        url = F.trim("url")
        split = F.split(url, "/")
        name = F.when(F.contains(url, F.lit("://")) & (F.size(split) > 2), F.get(split, F.lit(2))).otherwise(F.substring(url, 1, 64))
        action, resource = F.lit("execute-api:Invoke"), F.concat(F.lit("arn:aws:execute-api:::"), C.slug(name))
        size, extra, out = F.length(F.coalesce("content", F.lit(""))).cast("long"), F.create_map(F.lit("host"), name), F.lit(True)
    else:
        raise ValueError(f"no mapping for {source!r}")
    return rows.select(
        col("id").alias("event_id"), parsed_time(col("date")).alias("ts"), col("user").alias("principal"), action.alias("action"), resource.alias("resource"), F.lit(source).alias("source"),
        F.coalesce("pc", F.lit("")).alias("pc"), out.alias("egress"), size.alias("bytes_read"), extra.alias("extra"),
    ).where("ts is not null")


def events(spark: SparkSession, root: str, org: DataFrame, known: DataFrame | None = None, until: str | None = None, sources: tuple[str, ...] = ("logon", "device", "file", "http")) -> DataFrame:
    """Canonical events of all sources, labelled by (source, id), or by id alone where a label has no source."""
    units = org.select(F.col("principal").alias("user"), "unit_bucket")
    out = None
    for s in sources:
        rows = read_csv(spark, f"{root}/{s}.csv", M.HEADERS[s]).join(units, "user", "left")
        one = _event(rows, s, F.coalesce("unit_bucket", F.lit("org-unassigned")))
        out = one if out is None else out.unionByName(one)
    if until is not None:
        out = out.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    if known is None:
        return out.withColumn("label", F.lit(0).cast("byte"))
    keyed = known.where("source <> ''").select("source", "event_id", F.lit(1).alias("_a")).distinct()
    bare = known.where("source = ''").select("event_id", F.lit(1).alias("_b")).distinct()
    out = out.join(keyed, ["source", "event_id"], "left").join(bare, "event_id", "left")
    return out.withColumn("label", F.coalesce("_a", "_b", F.lit(0)).cast("byte")).drop("_a", "_b").select(*[f.name for f in M.EVENT.fields])


def write_splits(rows: DataFrame, split: Column, path: str, names: tuple[str, ...] = ("train", "train_malicious", "val", "test")) -> None:
    """One folder a split, in one pass over the rows; splits without rows get an empty table."""
    spark = rows.sparkSession
    rows.withColumn("__split", split).write.mode("overwrite").partitionBy("__split").parquet(f"{path}/all")
    place = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}")
    fs = place("all").getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        fs.delete(place(name), True)
        if not fs.rename(place(f"all/__split={name}"), place(name)) if fs.exists(place(f"all/__split={name}")) else True:
            spark.createDataFrame([], rows.schema).write.parquet(f"{path}/{name}")
    fs.delete(place("all"), True)
