"""Packing tokenised documents into fixed-length sequences by minimum bin slack.

A document's ids (word-level cache over the public tokenizer, whole texts) and one end id are cut
into pieces of at most ``capacity`` ids. Only the histogram of piece lengths (``capacity``
counters, whatever the input) reaches the driver. There, bin by bin, the longest remaining length
is placed and a bitset subset-sum over the remaining lengths finds the fullest feasible filling,
which is removed; a combination is taken as many times over as the counts allow, so the plan has
few patterns. Pieces get their place from their rank among pieces of the same length; ranks are
counted in salted groups, so that a frequent length is dealt over many tasks.

Defined results: null and empty texts give one piece that holds the end id alone; repeated rows
are packed as rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.bpe import byte_level
from tidewatch.llm.common import Learned, chunks, held, materialise, table, tokenizer_path

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Marks that may follow a word's letters; a run of them is one split of the tokenizer.
TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Texts are split into words in parts of so many characters.
PART_CHARS = 1 << 20
#: Pieces of one length that one salted group ranks, about.
RANKED_ROWS = 20_000
#: str.split() also splits at these, where the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: Byte (as its Latin-1 character) -> its printable stand-in in byte-level vocabularies.
BYTE_CHARS = {b: c for c, b in byte_level().items()}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Chunk between white space -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and nothing it does looks across it, so a text's ids are its
    chunks' ids in order.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.cores = Learned(), Learned()

    def forget(self) -> None:
        self.words.forget()
        self.cores.forget()

    def learn(self, words: set[str]) -> None:
        """Remember the words; letters with marks behind them are looked up as letters and marks.

        The tokenizer lower-cases letter by letter and splits a run of letters from a run of
        marks, so such a word's ids are those of its parts; every other word is encoded whole.
        """
        self.words.room()
        self.cores.room()
        split_up, whole, new = [], [], set()
        known, cores = self.words.known, self.cores.known
        for w in words:
            if w in known:
                continue
            core = w.rstrip(TAIL)
            if core.isalpha() and "<" not in w and (w.isascii() or ("\u03a3" not in w and unicodedata.is_normalized("NFC", core))):
                tail, core = w[len(core) :], core.lower()
                if core.isalpha():
                    split_up.append((w, core, tail))
                    if core not in cores:
                        new.add(core)
                    if tail and tail not in cores:
                        new.add(tail)
                    continue
            whole.append(w)
        tokenize, fresh = self.tokenizer.model.tokenize, list(new)
        mapped = [x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_CHARS) for x in fresh]
        self._keep(self.cores, fresh, [array("I", [t.id for t in tokenize(x)]).tobytes() for x in mapped])
        self._keep(self.words, [x[0] for x in split_up], [cores[core] + cores[tail] if tail else cores[core] for _, core, tail in split_up])
        for lo in range(0, len(whole), 20_000):
            part = whole[lo : lo + 20_000]
            self._keep(self.words, part, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])

    @staticmethod
    def _keep(where: Learned, keys: list[str], ids: list[bytes]) -> None:
        where.keep(keys, ids, sum(map(len, ids)))

    def joined(self, words: list[str]) -> bytes:
        get = self.words.known.__getitem__
        try:
            return b"".join(map(get, words))
        except KeyError:
            self.learn(set(words))
            return b"".join(map(get, words))

    def encode(self, text: str, words: list[str] | None = None) -> bytes:
        """The text's ids; ``words``: its split, where it is at hand."""
        if words is not None:
            return self.joined(words)
        return b"".join(self.joined(split(part)) for part in parts(text))


def parts(text: str) -> Iterator[str]:
    """The text in parts of about PART_CHARS, cut at spaces."""
    lo = 0
    while len(text) - lo > PART_CHARS:
        hi = text.find(" ", lo + PART_CHARS)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi + 1
    yield text[lo:] if lo else text


def split(text: str) -> list[str]:
    if any(map(text.__contains__, SEPARATORS)):
        return [w for w in WHITE.split(text) if w]
    return text.split()


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    with held(("words", path), lambda: WordIds(path)) as cache:
        yield from _pieces_of(batches, cache, capacity, end_id, with_ids)


def _pieces_of(batches: Iterator[pa.RecordBatch], cache: WordIds, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    end = np.asarray([end_id], "<u4").tobytes()
    for batch in chunks(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lists = [split(t) if t and len(t) <= PART_CHARS else None for t in texts]
        cache.learn(set().union(*filter(None, lists)))
        rows: list[tuple] = []
        for d, t, words in zip(ids, texts, lists, strict=True):
            data = (cache.encode(t, words) if t else b"") + end
            for k, lo in enumerate(range(0, len(data), 4 * capacity)):
                cut = data[lo : lo + 4 * capacity]
                rows.append((d, k, lo // 4, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<u4").astype(np.int64) if with_ids else None))
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(cols[5], pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def cut(docs: DataFrame, *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The documents' pieces; ``with_ids`` adds their ids as an array."""
    path = tokenizer_path(tokenizer)
    schema = PIECES + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: pieces_of(it, path, capacity, end_id, with_ids), schema)


def fullest(counts: np.ndarray, slack: int) -> dict[int, int]:
    """Bitset subset-sum: how many of each length fill ``slack`` best; longer ones are tried first."""
    if slack <= 0:
        return {}
    mask, reach, steps = (1 << (slack + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: slack + 1])[::-1].tolist():
        left, b = min(int(counts[length]), slack // length), 1
        while left:
            b = min(b, left)
            after = (reach | reach << length * b) & mask
            if after != reach:
                steps.append((length, b, reach))
                reach = after
            left, b = left - b, 2 * b
        if reach >> slack & 1:
            break
    s, used = reach.bit_length() - 1, {}
    for length, b, before in reversed(steps):
        if not before >> s & 1:
            used[length] = used.get(length, 0) + b
            s -= length * b
    return used


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(how many of each length, in how many sequences)]; counts[l]: pieces of length l."""
    counts, out = counts.astype(np.int64).copy(), []
    while (there := np.flatnonzero(counts)).size:
        longest = int(there[-1])
        counts[longest] -= 1
        used = fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(int(counts[n]) // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= times * k
        out.append((used, times))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, how many a sequence, first sequence, offset), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in patterns:
        at = 0
        for length in sorted(used, reverse=True):
            rows.append((length, rank.get(length, 0), used[length], sequence, at))
            rank[length] = rank.get(length, 0) + used[length] * times
            at += length * used[length]
        sequence += times
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece, length, ids_crc32) and sequence_id, offset.

    ``pieces`` is read three times: hand over a written table.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # one row for each length: capacity rows at most
        counts[r["length"]] = r["count"]
    table_of = slots(plan(counts, capacity))
    salts = int(counts.sum()) // RANKED_ROWS + 16
    shared = spark.sparkContext.broadcast(table_of)

    key = ["length", "_salt"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own).cast("long")).join(firsts, key)
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_first") - 1).alias("sequence_id"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        wide = int(t[:, 1].max(initial=0)) + 1 if len(t) else 1
        for batch in batches:
            n = batch.schema.get_field_index("length")
            length, rank = (np.asarray(batch.column(i)).astype(np.int64) for i in (n, batch.num_columns - 1))
            # a rank may pass every first rank of its length: it stays within its length's rows
            row = np.searchsorted(t[:, 0] * wide + t[:, 1], length * wide + np.minimum(rank, wide - 1), side="right") - 1
            bin_, slot = np.divmod(rank - t[row, 1], t[row, 2])
            cols = [*batch.columns[:-1], pa.array(t[row, 3] + bin_), pa.array(t[row, 4] + slot * length)]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def best_fit(docs: DataFrame, *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialise(cut(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
