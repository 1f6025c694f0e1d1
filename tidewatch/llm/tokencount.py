"""Exact token counts at every prefix of a text, without encoding a text twice.

A text is split by its tokenizer's pattern; for each distinct split a prefix recurrence
(``tidewatch.llm.bpe``) gives the exact count at each of its prefixes, and these counts are what is
kept. A text's table is the running sum over its splits with each split's own counts inside, so a
total, a budget test and the longest prefix within a budget are look-ups in it. Whole texts are
counted, in parts of bounded size; the remembered counts are bounded in bytes.

Pattern and special tokens come from the tokenizer's file; a file of another kind is refused.

Defined results: null counts as empty (0 bytes, 0 tokens); a special token's string inside a
text is one token, as the library has it by default; very long texts are counted as any other;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe
from tidewatch.llm.common import Learned, buffer_of, chunks, held, table, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Fixed value: the split pattern that a byte-level tokenizer uses where its file names none.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are split in parts of about so many characters, cut where a split surely ends.
PART_CHARS = 1 << 20
#: New splits go through the recurrence in groups of about so many characters.
GROUP_CHARS = 150_000
#: Splits up to this length are searched position by position.
SHORT = 64

_cut = regex.compile(r"(?<=\p{L}) (?=\p{L})")
_total = itemgetter(-1)


def parts(text: str) -> Iterator[str]:
    """The text in parts whose splits are the text's splits: cut before a space between letters."""
    lo = 0
    while len(text) - lo > PART_CHARS:
        found = _cut.search(text, lo + PART_CHARS)
        if not found:
            break
        yield text[lo : found.start()]
        lo = found.start()
    yield text[lo:] if lo else text


def settings(path: str) -> tuple[str, list[str]]:
    """(split pattern, special tokens) of a tokenizers file; ValueError where it asks for more than byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        body = json.load(f)
    steps = body["pre_tokenizer"] or {}
    steps = steps["pretokenizers"] if steps.get("type") == "Sequence" else [steps]
    last = steps[-1]
    ok = body["normalizer"] is None and body["model"]["type"] == "BPE" and last.get("type") == "ByteLevel" and not last["add_prefix_space"]
    pattern = BYTE_LEVEL
    if ok and not last["use_regex"]:
        first = steps[0]
        ok = len(steps) == 2 and first["type"] == "Split" and first["behavior"] == "Isolated" and not first["invert"] and "Regex" in first["pattern"]
        pattern = first["pattern"]["Regex"] if ok else ""
    odd = [t["content"] for t in body["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
    if not ok or odd or body["model"].get("ignore_merges") or body["model"].get("end_of_word_suffix"):
        raise ValueError(f"{path}: not plain byte-level BPE")
    return pattern, [t["content"] for t in body["added_tokens"]]


class Counter(Learned):
    """Split -> the counts at its byte prefixes, from the prefix recurrence."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.model = bpe.from_json(path)
        self.pattern, self.special = settings(path)
        self._split = regex.compile(self.pattern).findall
        self._marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def splits(self, text: str) -> list[str]:
        """The splits in order; a special token's string is one of them."""
        if not any(map(text.__contains__, self.special)):
            return self._split(text)
        out: list[str] = []
        for i, section in enumerate(self._marks(text)):
            out += [section] if i % 2 else self._split(section)
        return out

    def learn(self, words: set[str]) -> None:
        self.room()
        for s in self.special:
            self.known[s] = self.single(s)
        new = [w for w in words if w not in self.known and w]
        lo = 0
        while lo < len(new):
            hi, size = lo, 0
            while hi < len(new) and (hi == lo or size + len(new[hi]) < GROUP_CHARS):
                size += len(new[hi])
                hi += 1
            self._count(new[lo:hi])
            lo = hi

    @staticmethod
    def single(special: str) -> bytes:
        """A special token is whole or not there: its counts matter at its end alone."""
        return bytes([1] * len(special.encode()))

    def _count(self, words: list[str]) -> None:
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        symbols = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(d) for d in data])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        _, count = self.model.relax(len(symbols), starts, *self.model.edges(symbols, starts))
        small = count.astype(np.uint8).tobytes()
        counts = [small[a + 1 : z + 1] if total < 256 else array("I", count[a + 1 : z + 1].tolist()) for a, z, total in zip(starts.tolist(), ends.tolist(), count[ends].tolist(), strict=True)]
        self.keep(words, counts, len(small))

    def counts(self, words: list[str]) -> list[bytes]:
        """Each split's counts."""
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return list(map(self.known.__getitem__, words))

    def count(self, text: str) -> int:
        return sum(sum(map(_total, self.counts(self.splits(part)))) for part in parts(text))

    def table(self, text: str) -> PrefixTable:
        words = [w for part in parts(text) for w in self.splits(part)]
        return PrefixTable(self, words)

    def measured(self, text: str, limit: int, words: list[str] | None = None) -> tuple[int, int]:
        """(tokens, characters of the longest prefix of at most ``limit`` tokens) of a text, part by part.

        ``words``: the splits of a text of one part, where they are at hand. A table is held for
        the parts up to the limit only; parts end between letters, where no later part matters.
        """
        total, chars, cut = 0, 0, None
        for part in parts(text) if words is None else (text,):
            own = PrefixTable(self, self.splits(part) if words is None else words)
            if cut is None and total + own.total > limit:
                cut = chars + own.longest_within(limit - total)
            total, chars = total + own.total, chars + len(part)
        return total, len(text) if cut is None else cut


class PrefixTable:
    """Counts at the prefixes of one text.

    ``count(i)`` is the number of tokens of ``text[:i]`` by itself. A prefix that ends inside a
    split may split otherwise than the text does (white space runs, contractions): its last
    splits are taken anew from the split before.
    """

    def __init__(self, counter: Counter, words: list[str]) -> None:
        self.counter, self.words = counter, words
        self.own = counter.counts(words)
        self.counts = list(accumulate(map(_total, self.own), initial=0))
        self._ends: list[int] | None = None

    @property
    def ends(self) -> list[int]:
        if self._ends is None:
            self._ends = list(accumulate(map(len, self.words), initial=0))
        return self._ends

    @property
    def total(self) -> int:
        return self.counts[-1]

    def over(self, limit: int) -> bool:
        return self.total > limit

    def _plain(self, word: str) -> bool:
        """Whether a prefix of the split is a split of its own where the split stands."""
        return self.counter.pattern == BYTE_LEVEL and word not in self.counter.special and not (word[:1] == "'" and len(word) < 4)

    def count(self, chars: int) -> int:
        k = bisect_right(self.ends, chars) - 1
        back = max(0, k - 1)
        while back and self.words[back].isspace():
            back -= 1
        if chars >= self.ends[-1]:
            return self.total
        rest = "".join(self.words[back : k + 1])[: chars - self.ends[back]]
        inside = rest[self.ends[k] - self.ends[back] :]
        if k > back and rest and not rest[-1].isspace() and (not inside or self._plain(self.words[k])):
            return self.counts[k] + (self.own[k][len(inside.encode("utf-8", "surrogatepass")) - 1] if inside else 0)
        return self.counts[back] + sum(map(_total, self.counter.counts(self.counter.splits(rest))))

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix whose own count is at most ``budget``.

        Counts at split ends grow, and a prefix holds the tokens of all splits before the last two
        (a run of white space is at most two splits and may count less when it ends the prefix):
        so the search goes down from two splits past the budget and ends at once or nearly so.
        """
        if self.total <= budget:
            return self.ends[-1]
        for j in range(min(len(self.words), bisect_right(self.counts, budget) + 2) - 1, -1, -1):
            found = self._longest_in(j, budget)
            if found:
                return found
        return 0

    def _longest_in(self, j: int, budget: int) -> int:
        """The longest such prefix that ends inside split ``j`` or with it; 0: none."""
        lo, hi, word = self.ends[j], self.ends[j + 1], self.words[j]
        if hi - lo > SHORT and self._plain(word):
            if self.count(hi) <= budget:
                return hi
            sizes = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word[:-1]])
            fits = np.flatnonzero(np.asarray(self.own[j] if not isinstance(self.own[j], bytes) else np.frombuffer(self.own[j], np.uint8))[sizes - 1] + self.counts[j] <= budget)
            hi = lo + int(fits[-1]) + 1 if fits.size else lo + 1
        return next((i for i in range(hi, lo, -1) if self.count(i) <= budget), 0)


def counted(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    with held(("counts", path), lambda: Counter(path)) as c:
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = [c.splits(t) if len(t) <= PART_CHARS else None for t in texts]
            c.learn(set().union(*filter(None, words)))
            got = [c.measured(t, limit, w) for t, w in zip(texts, words, strict=True)]
            _, ends = buffer_of(batch.column(1))
            n = [k for k, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array([k for _, k in got], pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "within_chars"])


def token_counts(docs: DataFrame, *, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, within_chars for each row.

    ``within_chars``: characters of the text's longest prefix that has at most ``limit`` tokens by itself.
    """
    path = tokenizer_path(tokenizer)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: counted(it, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, within_chars long")


def truncated(docs: DataFrame, budget: int, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, text`` with each text cut to its longest prefix of at most ``budget`` tokens; null stays null."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with held(("counts", path), lambda: Counter(path)) as c:
            for batch in chunks(batches):
                out = [None if t is None else t[: c.measured(t, budget)[1]] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
