"""Spelling variants of a corpus' words: an even-partition pigeonhole join, verified, then forms and roots.

Words are counted a batch at a time and summed up by word. Two words within one edit, of l and l or
l + 1 letters, agree in the first l div 2 letters of the shorter or in its last l - l div 2: so each
word is indexed under its two even segments, with its length, and probes the index with the
substrings of its own that stand there if the other is as long or one shorter; in the latter case
the second substring is shifted by one. A segment that many words share (three letters of a short
word, a common ending) is not joined: what its words have left over is parted evenly again by the
same rule, which loses nothing, since words that agree in a segment are within one edit exactly if
their rests are. It ends where a rest is one letter long; such groups are bounded by the alphabet.
So a probe meets at most ``GROUP`` (or an alphabet of) words a segment, whatever the corpus.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one where
letters are deleted by hash; repeated rows count again; texts are taken whole, in parts that end
between words; an empty table gives no rows; ties of a form go to the smallest word; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import CHUNK_BYTES, materialise, table

#: Code points of a word and its occurrences, at least; a form has FACTOR times the word's.
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
#: A run loses a letter where this divides its hash (0: never).
DELETED = 199
#: Words of an index entry that are joined; entries with more are parted again.
GROUP = 48
#: Distinct words that a task sums up before it hands them on.
HELD_WORDS = 100_000

LOWER = {i: i + 32 for i in range(65, 91)}
OUTSIDE = re.compile("[^A-Za-zÀ-ÿ]")


def parts(text: str, limit: int = CHUNK_BYTES) -> Iterator[str]:
    """The text in parts of about ``limit`` characters that end between runs."""
    lo = 0
    while len(text) - lo > limit:
        stop = OUTSIDE.search(text, lo + limit)
        if not stop:
            break
        yield text[lo : stop.start()]
        lo = stop.start()
    yield text[lo:]


def word_counts(docs: DataFrame, *, letters: int = LETTERS, deleted: int = DELETED) -> DataFrame:
    """word, n: runs of letters of at least ``letters`` code points, lower-cased in A-Z, over all texts.

    Where ``deleted`` divides h, the crc32 of ``<doc_id>:<run>``, the run loses its letter h % length.
    """
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                seed = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id}:".encode())
                for part in parts(text.as_py() or ""):
                    for run, n in Counter(runs.findall(part)).items():
                        word = run.translate(LOWER)
                        h = zlib.crc32(word.encode(), seed) if deleted else 1
                        if deleted and not h % deleted:
                            i = h % len(word)
                            word = word[:i] + word[i + 1 :]
                            if len(word) < letters:
                                continue
                        found[word] += n
                    if len(found) >= HELD_WORDS:
                        yield out()
                        found.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def parted(rows: DataFrame) -> DataFrame:
    """Each row twice: under its rest's first segment, and under its last.

    Rows are (key, rest, m, d, word, n): ``m`` letters are left of the indexed word, ``d`` more of this one.
    """
    h, rest, m, d = F.expr("m div 2").cast("int"), F.col("rest"), F.col("m"), F.col("d")

    def child(place: int, segment: Column, left: Column, length: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(place), segment).alias("key"), left.alias("rest"), length.cast("int").alias("m"))

    first = child(1, F.substring(rest, F.lit(1), h), F.substring(rest, h + 1, m + d), m - h)
    last = child(2, F.substring(rest, h + d + 1, m), F.substring(rest, F.lit(1), h + d), h)
    return rows.select("d", "word", "n", F.explode(F.array(first, last)).alias("x")).select("x.*", "d", "word", "n")


def near_pairs(words: DataFrame, *, group: int = GROUP) -> DataFrame:
    """a, n_a, b, n_b: the pairs of (distinct) words (word, n) that are one edit apart, each pair once; b is as long as a or one longer."""
    size = F.length("word")
    index = words.select(size.cast("long").alias("key"), F.col("word").alias("rest"), size.alias("m"), F.lit(0).alias("d"), "word", "n")
    probe = words.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("d"), "word", "n", size.alias("s"))
    probe = probe.select((F.col("s") - F.col("d")).cast("long").alias("key"), F.col("word").alias("rest"), (F.col("s") - F.col("d")).alias("m"), "d", "word", "n")
    pairs = None
    while True:
        index, probe = materialise(parted(index), "index"), materialise(parted(probe), "probe")
        common = index.groupBy("key").agg(F.count("*").alias("size"), F.max("m").alias("m")).where((F.col("size") > group) & (F.col("m") > 1)).select("key")
        common = materialise(common, "common")
        none = common.isEmpty()
        rare = index if none else index.join(common, "key", "left_anti")
        a = rare.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = probe.select("key", "d", F.col("word").alias("b"), F.col("n").alias("n_b"))
        met = a.join(b, "key").where((F.col("d") == 1) | (F.col("a") < F.col("b")))
        near = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
        pairs = near if pairs is None else pairs.unionByName(near)
        if none:
            # a pair may meet under both segments; few candidates are near, so these are made distinct
            return pairs.distinct()
        index, probe = index.join(common, "key", "left_semi"), probe.join(common, "key", "left_semi")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): the last of the forms of forms; a form has more occurrences, so there is an end.

    Each round doubles the steps taken.
    """
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        went = materialise(at.join(on, at["root"] == on["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        at = went.select("word", "root")
        if went.where("moved").isEmpty():
            return at


def variants(words: DataFrame, *, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of the (distinct) words (word, n)."""
    words = materialise(words.select("word", "n"), "words")
    pairs = materialise(near_pairs(words, group=group), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("own"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("own"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("own").alias("own"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("own")
    best = materialise(best.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")).where(F.col("n") >= OCCURRENCES))
