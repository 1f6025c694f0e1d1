"""Quality by regularised quadratic discriminant over transformed document statistics.

Byte, word and line statistics of a batch are counted with array operations. Each class gets its
mean and a covariance shrunk towards the pooled diagonal; scores come from the difference of the
classes' log densities, by Mahalanobis distances through cached Cholesky factors. The difference
is put on the probability scale by a logistic fit on the training sample.

Defined results: null and empty texts are scored by their statistics (all zero); a null doc_id is
scored, held_out false; one class or none among the training labels gives the class's prior;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored. A text
may be of any length: beside it about ten bytes are held for each of its bytes and some fifty for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import buffer_of, chunks, crc_bucket, table
from tidewatch.llm.labelled import SAMPLE_ROWS, sample
from tidewatch.llm.linelabels import BLOCK, lines_of, words_of
from tidewatch.llm.toxicity import fit_logistic

#: Byte classes: lower, upper, digit, space, newline, sentence marks, brackets and quotes, other marks, control, non-ASCII.
N_CLASSES = 10
CLASS = np.full(256, 9, np.int64)
for _i in range(128):
    _c = chr(_i)
    CLASS[_i] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c == " " else 4 if _c == "\n" else 5 if _c in ".,;:?" else 6 if _c in "()[]{}\"'-" else 8 if _i < 32 or _i == 127 else 7
#: Share of the pooled diagonal in each class's covariance.
SHRINK = 0.15
FEATURES = ("log_bytes", "upper", "digit", "newline", "stops", "quotes", "marks", "control", "foreign", "word_length", "distinct_words", "repeated_lines", "log_lines", "top_word", "loud_marks", "repeated_pairs")


#: A byte as it counts in words and lines: capitals as small letters, white space within lines alike.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
SPACED = np.where((np.arange(256) <= 32) & (np.arange(256) != 10), np.uint8(95), FOLDED)


def hashed_lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each non-empty line."""
    row, start, stop = lines_of(data, ends)
    on = np.flatnonzero(stop > start)
    buf = memoryview(SPACED[data])
    h = np.fromiter((hash(buf[a:z].tobytes()) for a, z in zip(start[on].tolist(), stop[on].tolist(), strict=True)), np.int64, len(on))
    return h.view(np.uint64), row[on]


def byte_counts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows x N_CLASSES counts of byte classes, and each row's exclamation marks, a block of bytes at a time."""
    rows = len(ends) - 1
    counts, loud = np.zeros(rows * N_CLASSES, np.int64), np.zeros(rows, np.int64)
    for lo in range(0, len(data), BLOCK):
        part = data[lo : lo + BLOCK]
        first = int(np.searchsorted(ends, lo, side="right")) - 1
        last = int(np.searchsorted(ends, lo + len(part), side="left"))
        inner = np.diff(np.clip(ends[first : last + 1], lo, lo + len(part)))
        row = np.repeat(np.arange(last - first), inner)
        counts[first * N_CLASSES : last * N_CLASSES] += np.bincount(row * N_CLASSES + CLASS[part], minlength=(last - first) * N_CLASSES)
        loud[first:last] += np.bincount(row[part == 33], minlength=last - first)
    return counts.reshape(rows, N_CLASSES), loud


def distinct_share(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, distinct items, count of the most frequent item) of each row."""
    n = np.bincount(row, minlength=rows)
    if not len(h):
        return n, n.copy(), n.copy()
    h = h.copy()
    cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if z - a > 1:
            h[a:z].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[at], runs)
    return n, np.bincount(row[at], minlength=rows), most


def statistics(col: pa.Array) -> np.ndarray:
    """rows x FEATURES, transformed so that they spread evenly."""
    data, ends = buffer_of(col)
    rows, size = len(ends) - 1, np.diff(ends)
    counts, loud = byte_counts(data, ends)
    total = np.maximum(size, 1)
    first, w, _ = words_of(FOLDED[data], ends)
    row = np.searchsorted(ends, first, side="right") - 1
    n, distinct, most = distinct_share(w, row, rows)
    lines, own, _ = distinct_share(*hashed_lines(data, ends), rows)
    pair_row = row[:-1][row[:-1] == row[1:]] if len(row) else row
    pairs = (w[:-1] * np.uint64(3) + w[1:])[row[:-1] == row[1:]] if len(row) else w
    n_pairs, own_pairs, _ = distinct_share(pairs, pair_row, rows)
    share = lambda x, y: np.sqrt(x / np.maximum(y, 1))
    expected = np.maximum(n, 1.0) ** -0.3
    return np.column_stack([
        np.log1p(size), share(counts[:, 1], total), share(counts[:, 2], total), share(counts[:, 4], total), share(counts[:, 5], total), share(counts[:, 6], total), share(counts[:, 7], total), share(counts[:, 8], total), share(counts[:, 9], total),
        np.log1p(size / np.maximum(n, 1)), np.log((distinct + 1) / (n + 1)) - np.log(expected), share(lines - own, lines), np.log1p(lines), share(most, n), share(loud, total), share(n_pairs - own_pairs, n_pairs),
    ])


@dataclass(frozen=True)
class QualityModel:
    """Per class: prior log weight, mean and Cholesky factor; then the logistic scale and shift."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    consts: tuple[float, float]
    scale: tuple[float, float]
    prior: float | None = None

    @cached_property
    def inverses(self) -> tuple[np.ndarray, ...]:
        """Of the Cholesky factors, made once where the model is used."""
        return tuple(np.linalg.inv(low) for low in self.factors)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, tempered so that far outliers stay ranked."""
        out = []
        for mean, inverse, const in zip(self.means, self.inverses, self.consts, strict=True):
            z = inverse @ (x - mean).T
            out.append(const - 0.5 * (z * z).sum(axis=0))
        return np.arcsinh(out[1] - out[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * self.difference(x), -35, 35)))


def fit_arrays(x: np.ndarray, y: np.ndarray, w: np.ndarray, shrink: float = SHRINK) -> QualityModel:
    none = (np.zeros(0), np.zeros(0))
    if not len(y) or y.min() == y.max():
        return QualityModel(none, none, (0.0, 0.0), (0.0, 0.0), float(y[0]) if len(y) else 0.5)
    pooled = np.zeros(x.shape[1])
    for k in (0, 1):
        pooled += x[y == k].var(axis=0) * (y == k).mean()
    pooled = np.maximum(pooled, 1e-6)
    means, factors, consts = [], [], []
    for k in (0, 1):
        own = x[y == k]
        mean, d = own.mean(axis=0), own - own.mean(axis=0)
        cov = (1 - shrink) * (d.T @ d) / len(own) + shrink * np.diag(pooled)
        low = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(low)
        consts.append(float(np.log(w[y == k].sum() / w.sum()) - np.log(np.diag(low)).sum()))
    model = QualityModel(tuple(means), tuple(factors), tuple(consts), (0.0, 1.0))
    beta = fit_logistic(model.difference(x)[:, None], y.astype(float), w / w.mean())
    return QualityModel(model.means, model.factors, model.consts, (float(beta[0]), float(max(beta[1], 1e-3))))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, shrink: float = SHRINK) -> QualityModel:
    """Learn from training rows (crc32(doc_id) mod 3 is not 1); at most about ``rows`` of each class."""
    train = sample(docs, labels, "quality", modulus=3, held_out=1, rows=rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = statistics(batch.column(0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([flat, batch.column(1), batch.column(2)], ["x", "label", "weight"])

    got = train.select("text", "label", "weight").mapInArrow(features, "x array<double>, label int, weight double").toPandas()  # the bounded sample's numbers
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    y, w = got["label"].to_numpy(), got["weight"].to_numpy()
    order = np.lexsort((*x.T, y))
    return fit_arrays(x[order], y[order], w[order], shrink)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1))))], ["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
