"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line (trimmed, ``MIN_WORDS`` words at least) is dropped where an earlier line, by (doc_id,
position), equals it or is within one edit (insert, delete or change of a character); the
earliest stays. Equal lines are one distinct line, by 128 bits of hash and the length. With
``near_chars``, repeats of every non-blank line are dropped, and the one-edit match takes lines of
``MIN_WORDS`` words or of ``near_chars`` characters, so that scripts without blanks count too.

Within one edit means: the lines share the variant that leaves the edited character out, at the
same place (change), or one is a deletion variant of the other (insert, delete). Variants are
hashed keys; equal keys join, each line against its group's earliest only, which gives each line
its earliest neighbour without pairs within a group; joined lines are verified by edit distance.

Emitting a variant for every character of every line would multiply the input. A pair within one
edit agrees outside the edited segment, so lines are narrowed first: keys without the first or the
second half of the line, then without one of about sqrt(n / 32) segments, then without one of the
segment's parts of about 32 characters. Only lines whose key another line shares go on, and
variants leave out characters of the shared segment alone. This loses no pair.

Defined results: null text stays null (0 lines); blank lines stay, short ones too without ``near_chars``; a text without lines
to drop comes back unchanged; rows equal in doc_id and text are one document; null ids come
before all others; other columns are left alone, whatever their names; very long lines are
treated as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import NULL_ID, materialise, table

MIN_WORDS = 5
#: Characters from which the query matches lines within one edit, whatever their words.
NEAR_CHARS = 20
#: Characters of the segments that variants are emitted from, about.
SEGMENT = 32
BLANKS = " \t\r "

LINE = ["h1", "h2", "len"]
AT = ["d", "t", "pos"]


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """d, t: the document's place in the order and its text's hash."""
    return docs.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("t", F.xxhash64(text))


def worded(line: str, words: int) -> Column:
    return F.col(line).rlike(rf"^(\S+\s+){{{words - 1}}}\S") if words > 1 else F.length(line) > 0


def lines_of(docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """d, t, pos, line, h1, h2, len of each line that counts."""
    t = f"`{text_col}`"
    rows = docs.select("doc_id", F.col(t).alias("x")).where("x is not null")
    rows = keyed(rows, "x").select("d", "t", F.posexplode(F.split("x", "\n", -1)).alias("pos", "raw"))
    rows = rows.select("d", "t", "pos", F.btrim("raw", F.lit(BLANKS)).alias("line"))
    rows = rows.where(worded("line", min_words))
    return rows.select(*AT, "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("len"))


def right(text: Column, n: Column) -> Column:
    """The last ``n`` characters (none for 0)."""
    return F.substring(text, F.length(text) - n + 1, n)


def half_keys(text: str, length: str) -> list[Column]:
    """Keys without the second or the first half, for the line's length and one less."""
    out = []
    for less in (0, 1):
        n = F.col(length) - less
        p = (n / 2).cast("int")
        out += [F.xxhash64(F.lit("front"), n, F.substring(F.col(text), F.lit(1), p)), F.xxhash64(F.lit("back"), n, right(F.col(text), n - p))]
    return out


def shared(rows: DataFrame, key: str) -> DataFrame:
    """The keys of more than one distinct line."""
    return rows.groupBy(key).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select(key)


def narrowed(rows: DataFrame, parts: Column) -> DataFrame:
    """Rows (line, n, s, e) -> the parts of [s, e) without which another line has the same rest."""
    cut = rows.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    span = F.col("e") - F.col("s")
    s = F.col("s") + F.floor(F.col("i") * span / F.col("parts")).cast("int")
    e = F.col("s") + F.floor((F.col("i") + 1) * span / F.col("parts")).cast("int")
    cut = cut.select(*LINE, "line", "first", "n", s.alias("s"), e.alias("e"))
    key = F.xxhash64("n", "s", "e", F.substring(F.col("line"), F.lit(1), F.col("s")), right(F.col("line"), F.col("n") - F.col("e")))
    cut = cut.withColumn("key", key)
    return cut.join(shared(cut, "key"), "key", "left_semi")


def neighbours(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2, len, near: lines with an earlier line within one edit, and the earliest such place."""
    ids = distinct.select(*LINE, "first", F.explode("halves").alias("k"))
    alive = ids.join(shared(ids, "k"), "k", "left_semi").select(*LINE, "first").distinct()
    at = F.struct(*AT)
    held = lines.join(alive.select(*LINE, "first"), LINE).where(at == F.col("first")).select(*LINE, "line", "first").dropDuplicates(LINE)
    held = materialise(held, "lines")
    rows = held.withColumn("n", F.explode(F.array(F.col("len"), F.col("len") - 1))).select(*LINE, "line", "first", "n", F.lit(0).alias("s"), F.col("n").alias("e"))
    rows = narrowed(rows, F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n") / SEGMENT)).cast("int")))
    rows = narrowed(rows.drop("key"), F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("s")) / SEGMENT).cast("int")))
    rows = rows.withColumn("mid", F.expr("substring(line, s + 1, len - s - (n - e))"))
    variants = F.expr("""
        if(len = n,
           concat(array(named_struct('v', xxhash64('d', key, mid), 'role', 'base')),
                  transform(sequence(1, length(mid)), p -> named_struct('v', xxhash64('h', key, p, substring(mid, 1, p - 1), substring(mid, p + 1)), 'role', 'hole'))),
           transform(sequence(1, length(mid)), p -> named_struct('v', xxhash64('d', key, concat(substring(mid, 1, p - 1), substring(mid, p + 1))), 'role', 'less')))""")
    emitted = rows.where("length(mid) > 0").select(*LINE, "first", F.inline(variants)).distinct()
    who = F.struct("first", *LINE)
    best = emitted.groupBy("v").agg(*[F.min(F.when(F.col("role") == r, who)).alias(r) for r in ("base", "hole", "less")], F.count("*").alias("many")).where("many > 1").drop("many")
    pick = F.when(F.col("role") == "hole", F.col("hole")).when(F.col("role") == "less", F.col("base")).otherwise(F.col("less"))
    met = emitted.join(best, "v").select(*LINE, "first", pick.alias("by")).where("by is not null").where("by.first < first")
    met = met.select(*LINE, F.col("by.first").alias("near"), *[F.col(f"by.{c}").alias(f"o_{c}") for c in LINE]).distinct()
    other = held.select(*[F.col(c).alias(f"o_{c}") for c in LINE], F.col("line").alias("o_line"))
    both = met.join(held.select(*LINE, "line"), LINE).join(other, [f"o_{c}" for c in LINE])
    ok = both.where(F.levenshtein("line", "o_line", 1).between(0, 1))
    return ok.groupBy(*LINE).agg(F.min("near").alias("near"))


def dropped(docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS, max_edits: int = 1, near_chars: int | None = None) -> DataFrame:
    """d, t, pos of the lines that an earlier line stands for."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = lines_of(docs, text_col=text_col, min_words=min_words if near_chars is None else 1)
    halves = F.array(*half_keys("line", "len"))
    if near_chars is not None:
        halves = F.when(worded("line", min_words) | (F.col("len") >= near_chars), halves)
    keys = LINE + (["halves"] if max_edits else [])
    rows = lines.select(*AT, *LINE, *([halves.alias("halves")] if max_edits else []))
    distinct = materialise(rows.groupBy(*keys).agg(F.min(F.struct(*AT)).alias("first"), F.count("*").alias("copies")), "distinct-lines")
    known = distinct.where("copies > 1").select(*LINE, F.col("first").alias("e"))
    if max_edits:
        known = known.union(neighbours(lines, distinct).select(*LINE, F.col("near").alias("e")))
    known = known.groupBy(*LINE).agg(F.min("e").alias("e"))
    return lines.select(*AT, *LINE).join(known, LINE).where(F.struct(*AT) > F.col("e")).select(*AT)


def dedup(docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS, max_edits: int = 1, near_chars: int | None = None, count_cols: bool = False) -> DataFrame:
    """``docs`` with the dropped lines cut from ``text_col``; ``count_cols`` adds n_lines and n_removed."""
    t = F.col(f"`{text_col}`")
    gone = dropped(docs, text_col=text_col, min_words=min_words, max_edits=max_edits, near_chars=near_chars)
    words = gone.groupBy("d", "t", F.expr("cast(pos div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("mask"))
    masks = words.groupBy("d", "t").agg(F.collect_list(F.struct("w", "mask")).alias("ms"), F.sum(F.bit_count("mask")).alias("n_gone"))
    dense = F.expr("transform(sequence(0, array_max(transform(ms, m -> m.w))), i -> coalesce(get(filter(ms, m -> m.w = i), 0).mask, 0L))")
    masks = masks.select(F.col("d").alias("__d"), F.col("t").alias("__t"), dense.alias("__masks"), F.col("n_gone").cast("long").alias("__gone"))
    own = docs.withColumn("__kd", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__kt", F.xxhash64(t))
    both = own.join(masks, (F.col("__kd") == F.col("__d")) & (F.col("__kt") == F.col("__t")), "left")
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n', -1), (x, i) -> (shiftright(coalesce(get(__masks, cast(i div 64 as int)), 0L), i % 64) & 1L) = 0L), '\\n')")
    extra = [F.when(t.isNull(), F.lit(0)).otherwise(F.size(F.split(t, "\n", -1))).cast("long").alias("n_lines"), F.coalesce("__gone", F.lit(0).cast("long")).alias("n_removed")] if count_cols else []
    cols = [F.when(F.col("__masks").isNull(), t).otherwise(kept).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*cols, *extra)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), near_chars=NEAR_CHARS, count_cols=True)
