"""SentencePiece encoding and decoding by suffix-array matching.

The pieces' model file is read, not trained. A batch's distinct chunks (a run of word marks and
what follows it; no piece goes beyond one) are concatenated and indexed by a suffix array as deep
as the longest piece. Every vocabulary piece's occurrences are a range of it, found by binary
search; the ranges' places are the edges, which are sorted by position and relaxed: at each
position the last piece is the one compatible with the last piece before it, which is the merge
order's encoding. Characters outside the vocabulary become byte pieces.

Defined results: null counts as empty (no ids); control pieces' strings inside texts are ordinary
text, as the library has it; decoding an encoding gives the text back; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.bpe import Model
from tidewatch.llm.common import Learned, chunks, held, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters indexed at once.
INDEX_CHARS = 1 << 20
#: Longer texts are encoded in parts of about so many characters, cut before a space.
PART_CHARS = 1 << 20

_chunks = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


def suffix_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array up to ``depth`` symbols, by prefix doubling from packed keys."""
    n = len(symbols)
    there = np.zeros(int(symbols.max(initial=0)) + 1, bool)
    there[symbols] = True
    code = np.cumsum(there)[symbols].astype(np.uint64)
    bits = int(code.max(initial=1)).bit_length()
    width = 64 // bits
    padded = np.append(code, np.zeros(width, np.uint64))
    key = padded[:n].copy()
    for j in range(1, width):
        key = key << np.uint64(bits) | padded[j : n + j]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        by = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(np.uint64(1), (by[1:] != by[:-1]).astype(np.uint64)))
        after = np.append(rank[width:], np.zeros(min(width, n), np.uint64))
        key = rank * np.uint64(n + 2) + after
        width *= 2


class Pieces(Learned):
    """A piece vocabulary with its exact encoder and decoder."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.normalizer_spec.escape_whitespaces or len(proto.normalizer_spec.precompiled_charsmap):
            raise ValueError("a BPE model without normalisation is expected")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type in (2, 3)}
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        score = np.array([p.score for p in proto.pieces])
        size = len(self.pieces)
        rank, left, right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        place = {s: i for i, s in enumerate(sorted({-float(score[i]) for i in normal.values()}))}
        pairs = {}
        for s, i in normal.items():
            if len(s) < 2:
                continue
            rank[i] = place[-float(score[i])]
            for cut in range(1, len(s)):
                a, b = normal.get(s[:cut]), normal.get(s[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.reachable: set[int] = set()
        for s, i in normal.items():
            if len(s) == 1:
                self.reachable.add(i)
                continue
            parts = self._merge([normal.get(c, -1) for c in s], pairs, rank)
            if parts and parts[2] == i:
                left[i], right[i] = parts[0], parts[1]
                self.reachable.add(i)
        own = {i: [ord(c) for c in s] for s, i in normal.items() if i in self.reachable}
        self.model = Model(rank, left, right, pairs, own)
        self.single = {s: i for s, i in normal.items() if len(s) == 1}
        self.codes = np.array(sorted(ord(c) for c in self.single), np.int64)
        order = sorted(own, key=lambda i: self.pieces[i])
        self.sorted_ids = np.array(order, np.int64)
        self.longest = max(len(s) for s in own.values())
        self.padded = np.zeros((len(order), self.longest), np.int64)
        for r, i in enumerate(order):
            self.padded[r, : len(own[i])] = own[i]
        self.own_len = np.array([len(own[i]) for i in order])
        self.unknown = size  # stands for a character outside the vocabulary; it merges with nothing
        self.model.rank = np.append(self.model.rank, -1)
        self.model.left, self.model.right = np.append(self.model.left, size), np.append(self.model.right, size)
        self.model.lengths = np.append(self.model.lengths, 1)

    @staticmethod
    def _merge(ids: list[int], pairs: dict, rank: np.ndarray) -> tuple[int, int, int] | None:
        """The last merge (left, right, made) when a piece's characters are merged by rank."""
        last = None
        while len(ids) > 1:
            best, at = None, -1
            for j in range(len(ids) - 1):
                made = pairs.get((ids[j], ids[j + 1]))
                if made is not None and (best is None or rank[made] < rank[best]):
                    best, at = made, j
            if best is None:
                return None
            last = (ids[at], ids[at + 1], best)
            ids = ids[:at] + [best] + ids[at + 2 :]
        return last

    def edges(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all occurrences: a suffix-array range for each piece."""
        n = len(symbols)
        order = suffix_ranks(symbols, self.longest)
        lo, hi = np.zeros(len(self.sorted_ids), np.int64), np.full(len(self.sorted_ids), n, np.int64)
        padded = np.append(symbols, np.zeros(self.longest, np.int64))
        for d in range(self.longest):
            # within [lo, hi) suffixes agree on d symbols: both ends of the next symbol's range by bisection
            mine = np.flatnonzero((self.own_len > d) & (lo < hi))
            if not mine.size:
                break
            want, column = self.padded[mine, d], padded[order + d]
            for side in (0, 1):
                a, z = lo[mine].copy(), hi[mine].copy()
                while (open_ := a < z).any():
                    mid = (a + z) // 2
                    value = column[np.minimum(mid, n - 1)]
                    go = open_ & ((value < want) if side == 0 else (value <= want))
                    a = np.where(go, mid + 1, a)
                    z = np.where(open_ & ~go, mid, z)
                if side == 0:
                    first = a
                else:
                    hi[mine] = a
            lo[mine] = first
        many = np.maximum(hi - lo, 0)
        token = np.repeat(self.sorted_ids, many)
        size = np.repeat(self.own_len, many)
        offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        start = order[np.repeat(lo, many) + offset]
        word_end = np.append(starts[1:], n)[np.searchsorted(starts, start, side="right") - 1]
        inside = start + size <= word_end
        start, size, token = start[inside], size[inside], token[inside]
        known = np.isin(symbols, self.codes)
        lone = np.flatnonzero(~known)
        start, size, token = np.append(start, lone), np.append(size, np.ones(len(lone), np.int64)), np.append(token, np.full(len(lone), self.unknown))
        by = np.argsort(start, kind="stable")
        return start[by], start[by] + size[by], token[by]

    def learn(self, words: set[str]) -> None:
        self.room()
        new = [w for w in words if w not in self.known]
        lo = 0
        while lo < len(new):
            hi, size = lo, 0
            while hi < len(new) and (hi == lo or size + len(new[hi]) < INDEX_CHARS):
                size += len(new[hi])
                hi += 1
            self._encode(new[lo:hi])
            lo = hi

    def _encode(self, words: list[str]) -> None:
        symbols = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        last, _ = self.model.relax(len(symbols), starts, *self.edges(symbols, starts))
        ids, many = self.model.tokens(last, starts, ends)
        stop = np.cumsum(many)
        foreign = set(np.searchsorted(stop, np.flatnonzero(ids == self.unknown), side="right").tolist())
        data, found = ids.astype("<u4").tobytes(), []
        for i, (w, z, m) in enumerate(zip(words, stop.tolist(), many.tolist(), strict=True)):
            if i not in foreign:
                found.append(data[4 * (z - m) : 4 * z])
                continue
            out, at = [], 0
            for t in ids[z - m : z].tolist():
                if t == self.unknown:
                    out += [self.byte_id[b] for b in w[at].encode("utf-8", "surrogatepass")]
                    at += 1
                else:
                    out.append(t)
                    at += len(self.pieces[t])
            found.append(np.array(out, "<u4").tobytes())
        self.keep(words, found, len(data))

    def marked(self, text: str) -> Iterator[str]:
        """The text with word marks for spaces, in parts cut before a mark."""
        whole = (" " + text if self.prefix else text).replace(" ", MARK)
        lo = 0
        while len(whole) - lo > PART_CHARS:
            hi = whole.find(MARK, lo + PART_CHARS)
            while hi > 0 and whole[hi - 1] == MARK:
                hi = whole.find(MARK, hi + 1)
            if hi < 0:
                break
            yield whole[lo:hi]
            lo = hi
        yield whole[lo:] if lo else whole

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        out = []
        for part in self.marked(text):
            words = _chunks(part)
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
            except KeyError:
                self.learn(set(words))
                out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        out, run = [], bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            b = self.id_byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.control:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def encoded(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    with held(("pieces", path), lambda: Pieces(path)) as p:
        yield from _encoded(batches, p, with_ids)


def _encoded(batches: Iterator[pa.RecordBatch], p: Pieces, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        known: set[str] = set()
        for t in texts:
            if t and len(t) <= PART_CHARS:
                for part in p.marked(t):
                    known.update(_chunks(part))
        p.learn(known)
        ids = [p.encode(t) for t in texts]
        # what decoding can't tell apart: a mark written in the text is a space afterwards
        back = [p.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
        arrays = [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(back, pa.bool_())]
        names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def encode(docs: DataFrame, *, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip; ``with_ids`` adds ids."""
    path = tokenizer_path(model)
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: encoded(it, path, with_ids), schema)


def decode(rows: DataFrame, *, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give null."""
    path = tokenizer_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with held(("pieces", path), lambda: Pieces(path)) as p:
            for batch in batches:
                out = [None if i is None else p.decode(np.asarray(i, "<u4").tobytes()) for i in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
