"""Quality rules: counting rules first, then lines labelled content or boilerplate by a linear-chain CRF.

Counts of bytes, words and lines of a batch are made with array operations, a block of bytes at a
time. Each line with a word has a few features (shares of capitals, digits, marks, repeated words;
whether an earlier line equals it). The field scores a labelling by the lines' features and by the
labels of neighbours; Viterbi decoding finds the best one, and a document stays if content lines hold
at least half of its word characters.

The field is fitted by likelihood on a bounded sample of documents with a quality label. Lines of good
ones begin as content, lines of poor ones as boilerplate, and the features' weights are fitted without
regard to neighbours. Lines that look otherwise are relabelled, unless they are most of their document,
and the whole field is fitted to these labels; so a good document's header and a poor one's
sentences teach it how labels change.

Defined results: null and empty texts have no words (base_failed); a null doc_id keeps its row; blank
lines have no label; ties of two labellings go to content; repeated rows give repeated results; an
empty table gives no rows; without training rows of both kinds every line is content; other columns
are ignored. A text may be of any length: beside it about ten bytes are held for each of its bytes
and some forty for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import buffer_of, chunks, mix64, table
from tidewatch.llm.labelled import sample

#: Base rules: words at least; percent of words in repeated windows at most; words of a window.
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Share of word characters in content lines from which a document stays.
CONTENT_SHARE = 0.5
#: Documents of each quality that the field is fitted on, about; lines of a training sequence.
SAMPLE_ROWS, SEQUENCE = 2_000, 32
#: Steps of the fit, of single lines and then of the whole field; weight of the penalty on squares.
STEPS, PENALTY = (80, 100), 1e-3
#: Bytes that one array step works on.
BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Byte classes of a line: capitals, digits, symbols, exclamation marks, sentence marks, the rest.
CLASS = np.full(256, 5, np.int64)
CLASS[65:91], CLASS[48:58], CLASS[SYMBOL], CLASS[ord("!")] = 0, 1, 2, 3
CLASS[[ord(c) for c in ".,;:?"]] = 4
N_CLASSES = 6
#: A line's features count the more the longer it is: all but "one" are times the logarithm of its words.
FEATURES = ("one", "log_words", "capitals", "digits", "symbols", "loud", "sentence", "in_repeats", "same_word", "seen_before", "word_bytes")
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)]


@dataclass
class Counted:
    """Counts of the lines and rows (texts) of one byte buffer."""

    line_row: np.ndarray
    line_start: np.ndarray
    line_words: np.ndarray
    line_chars: np.ndarray
    features: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def lines_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of each line, in order; a text has one line more than line breaks."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(ends) - 1), np.searchsorted(ends, breaks, side="right") - 1])
    start = np.concatenate([ends[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    stop = np.append(start[1:] - 1, ends[-1])
    last = np.append(row[1:] != row[:-1], True)
    stop[last] = ends[1:][row[last]]
    return row, start, stop


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, hash, characters) of each word: a word's hash is the sum of mixed (byte, place) values."""
    n = len(data)
    inside = ~SPACE[data]
    start = inside.copy()
    edge = ends[1:-1]
    start[1:] &= ~inside[:-1]
    edge = edge[edge < n]
    start[edge] = inside[edge]
    first = np.flatnonzero(start)
    h, chars = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64)
    before = 0
    for lo in range(0, n, BLOCK):
        own = inside[lo : lo + BLOCK]
        word = (np.cumsum(start[lo : lo + BLOCK]) + before - 1)[own]
        before += int(np.count_nonzero(start[lo : lo + BLOCK]))
        if not word.size:
            continue
        at = np.flatnonzero(own) + lo
        byte = data[at]
        value = mix64((byte.astype(np.uint64) + np.uint64(1) + ((at - first[word]).astype(np.uint64) << np.uint64(8))) * ODD[0])
        cut = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        h[word[cut]] += np.add.reduceat(value, cut)
        chars[word[cut]] += np.add.reduceat(((byte & 0xC0) != 0x80).astype(np.int64), cut)
    return first, mix64(h * ODD[1]), chars


def in_repeats(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of ``WINDOW`` words that its text holds twice or more."""
    m, out = len(h) - WINDOW + 1, np.zeros(len(h), bool)
    if m < 2:
        return out
    acc = h[:m].copy()
    for k in range(1, WINDOW):
        acc = mix64(acc) + h[k : k + m] * ODD[2]
    key = mix64(acc + row[:m].astype(np.uint64) * ODD[0])
    at = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
    at = at[np.argsort(key[at])]
    same = key[at][1:] == key[at][:-1]
    twice = np.zeros(m, bool)
    twice[at[1:][same]] = twice[at[:-1][same]] = True
    for k in range(WINDOW):
        out[k : k + m] |= twice
    return out


def counted(col: pa.Array) -> Counted:
    data, ends = buffer_of(col)
    rows, n = len(ends) - 1, len(data)
    line_row, line_start, line_stop = lines_of(data, ends)
    lines = len(line_row)
    classes = np.zeros(lines * N_CLASSES, np.int64)
    before = 0
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        a, z = np.searchsorted(line_start, [lo, hi])
        new = np.zeros(hi - lo, np.int64)
        np.add.at(new, line_start[a:z] - lo, 1)
        line = np.cumsum(new) + before - 1
        before += int(z - a)
        least, most = int(line[0]), int(line[-1]) + 1
        classes[least * N_CLASSES : most * N_CLASSES] += np.bincount((line - least) * N_CLASSES + CLASS[data[lo:hi]], minlength=(most - least) * N_CLASSES)
    classes = classes.reshape(lines, N_CLASSES)
    first, h, chars = words_of(data, ends)
    line = np.searchsorted(line_start, first, side="right") - 1
    row = line_row[line]
    repeats = in_repeats(h, row)
    n_words = np.bincount(line, minlength=lines)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    # equal lines, by text
    dup = np.zeros(lines, bool)
    buf = memoryview(np.ascontiguousarray(data))
    worded = np.flatnonzero(n_words)
    seen: set[int] = set()
    was = -1
    for i, r, a, z in zip(worded.tolist(), line_row[worded].tolist(), line_start[worded].tolist(), line_stop[worded].tolist(), strict=True):
        if r != was:
            was = r
            seen.clear()
        x = hash(buf[a:z].tobytes())
        if x in seen:
            dup[i] = True
        else:
            seen.add(x)
    line_chars = np.bincount(line, weights=chars, minlength=lines).astype(np.int64)
    w, size = np.maximum(n_words, 1), np.maximum(line_stop - line_start, 1)
    share = lambda x, y: np.sqrt(np.minimum(1, x / y))
    by_line = lambda which: np.bincount(line[which], minlength=lines)
    length = np.log1p(n_words) / 3
    shares = [
        share(classes[:, 0], size), share(classes[:, 1], size), share(classes[:, 2], w), share(classes[:, 3], w), share(classes[:, 4], w), share(by_line(repeats), w), share(by_line(same), w), dup, np.log1p(line_chars / w) / 2,
    ]
    features = np.column_stack([np.ones(lines), length, *[x * length for x in shares]])
    own = lambda x: np.bincount(line_row, weights=x, minlength=rows).astype(np.int64)
    return Counted(line_row, line_start, n_words, line_chars, features, own(n_words), own(line_chars), own(classes[:, 2]), own(dup), np.bincount(row[repeats], minlength=rows))


@dataclass(frozen=True)
class Field:
    """Weights of the features for content, of a first content line, and of the labels of neighbours (before, after)."""

    weights: tuple[float, ...]
    first: float
    steps: tuple[tuple[float, float], tuple[float, float]]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best labelling (True: content) of one text's lines."""
        if not len(x):
            return np.zeros(0, bool)
        (t00, t01), (t10, t11) = self.steps
        gain = (x @ np.array(self.weights)).tolist()
        poor, good = 0.0, gain[0] + self.first
        back: list[tuple[bool, bool]] = []
        for g in gain[1:]:
            to_poor, to_good = good + t10 >= poor + t00, good + t11 >= poor + t01
            poor, good = (good + t10 if to_poor else poor + t00), (good + t11 if to_good else poor + t01) + g
            back.append((to_poor, to_good))
        label = good >= poor
        out = [label]
        for to_poor, to_good in reversed(back):
            label = to_good if label else to_poor
            out.append(label)
        return np.array(out[::-1], bool)


#: Every line is content.
NO_FIELD = Field((1.0,) + (0.0,) * (len(FEATURES) - 1), 0.0, ((0.0, 0.0), (0.0, 0.0)))


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log likelihood of the labels and its gradient.

    x: sequences x lines x features, y and mask: sequences x lines, lines that are there come first.
    theta: the features' weights, the first line's, the four steps'.
    """
    n, length, f = x.shape
    gain, first, steps = x @ theta[:f], theta[f], theta[f + 1 :].reshape(2, 2)
    ahead = np.zeros((n, length, 2))
    ahead[:, 0, 1] = gain[:, 0] + first
    for t in range(1, length):
        at = ahead[:, t - 1, :, None] + steps
        ahead[:, t] = np.where(mask[:, t, None], np.logaddexp(at[:, 0], at[:, 1]) + np.stack([np.zeros(n), gain[:, t]], axis=1), ahead[:, t - 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    behind = np.zeros((n, 2))
    got, want = np.zeros((n, length)), np.where(mask, y, 0.0)
    pairs = np.zeros((n, 2, 2))
    seen = np.zeros((n, 2, 2))
    for t in range(length - 1, -1, -1):
        on = mask[:, t]
        got[:, t] = np.where(on, np.exp(ahead[:, t, 1] + behind[:, 1] - total), 0)
        if t:
            after = np.stack([behind[:, 0], behind[:, 1] + gain[:, t]], axis=1)
            p = np.exp(ahead[:, t - 1, :, None] + steps + after[:, None, :] - total[:, None, None])
            pairs += np.where(on[:, None, None], p, 0)
            a, b = y[:, t - 1].astype(int), y[:, t].astype(int)
            seen[np.arange(n), a, b] += on
            at = steps[None] + after[:, None, :]
            behind = np.where(on[:, None], np.logaddexp(at[:, :, 0], at[:, :, 1]), behind)
    score = (want * gain).sum(axis=1) + want[:, 0] * first + (seen * steps).sum(axis=(1, 2))
    size = weight.sum()
    error = (want - got) * weight[:, None]
    grad = np.concatenate([np.einsum("nt,ntf->f", error, x), [error[:, 0].sum()], np.einsum("n,nab->ab", weight, seen - pairs).reshape(-1)]) / size
    return float((weight * (score - total)).sum() / size), grad


def ascend(theta: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: np.ndarray, steps: int, free: np.ndarray, rate: float = 0.2) -> np.ndarray:
    """Adaptive moment steps up the penalised likelihood, of the parameters that are ``free`` (1, else 0)."""
    m = v = np.zeros_like(theta)
    for i in range(1, steps + 1):
        g = free * (likelihood(theta, x, y, mask, weight)[1] - 2 * PENALTY * theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return theta


def field_of(theta: np.ndarray) -> Field:
    f = len(theta) - 5
    (a, b), (c, d) = theta[f + 1 :].reshape(2, 2).tolist()
    return Field(tuple(theta[:f].tolist()), float(theta[f]), ((a, b), (c, d)))


def fit_sequences(texts: list[np.ndarray], chars: list[np.ndarray], good: np.ndarray, steps: tuple[int, int] = STEPS) -> Field:
    """A field from texts (lines x features, word characters of the lines) and whether each is good."""
    use = [i for i, t in enumerate(texts) if len(t)]
    if len({bool(good[i]) for i in use}) < 2:
        return NO_FIELD
    labels = {i: np.full(len(texts[i]), bool(good[i])) for i in use}
    cuts = [(i, lo) for i in use for lo in range(0, len(texts[i]), SEQUENCE)]
    x, mask = np.zeros((len(cuts), SEQUENCE, len(FEATURES))), np.zeros((len(cuts), SEQUENCE), bool)
    for j, (i, lo) in enumerate(cuts):
        part = texts[i][lo : lo + SEQUENCE]
        x[j, : len(part)], mask[j, : len(part)] = part, True

    def truth() -> np.ndarray:
        y = np.zeros((len(cuts), SEQUENCE))
        for j, (i, lo) in enumerate(cuts):
            part = labels[i][lo : lo + SEQUENCE]
            y[j, : len(part)] = part
        return y

    # both kinds count alike, and so do a kind's documents
    n_good = sum(bool(good[i]) for i in use)
    weight = np.array([(0.5 / (n_good if good[i] else len(use) - n_good)) * mask[j].sum() / len(texts[i]) for j, (i, _) in enumerate(cuts)])
    alone = np.append(np.ones(len(FEATURES)), np.zeros(5))
    theta = ascend(np.zeros(len(FEATURES) + 5), x, truth(), mask, weight, steps[0], alone)
    field = field_of(theta)
    for i in use:
        label = field.viterbi(texts[i])
        if (chars[i][label].sum() >= CONTENT_SHARE * chars[i].sum()) == bool(good[i]):
            labels[i] = label
    return field_of(ascend(theta, x, truth(), mask, weight, steps[1], np.ones(len(theta))))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, steps: tuple[int, int] = STEPS) -> Field:
    """Learn from labelled rows (crc32(doc_id) mod 3 is not 1), at most about ``rows`` of each quality."""
    train = sample(docs, labels, "quality", modulus=3, held_out=1, rows=rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            c = counted(batch.column(0))
            on = np.flatnonzero(c.line_words)
            cuts = np.searchsorted(c.line_row[on], np.arange(batch.num_rows + 1))
            x = [c.features[on[a:z]].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            n = [c.line_chars[on[a:z]].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(n, pa.binary()), batch.column(1)], ["x", "chars", "label"])

    got = train.select("text", "label").mapInArrow(features, "x binary, chars binary, label int").toPandas()  # the bounded sample's numbers
    got = got.sort_values(["label", "x"])
    texts = [np.frombuffer(b, float).reshape(-1, len(FEATURES)) for b in got["x"]]
    return fit_sequences(texts, [np.frombuffer(b, np.int64) for b in got["chars"]], got["label"].to_numpy() == 1, steps)


def decoded(field: Field, c: Counted) -> np.ndarray:
    """Whether each line is content; blank lines are not."""
    out = np.zeros(len(c.line_row), bool)
    on = np.flatnonzero(c.line_words)
    cuts = np.searchsorted(c.line_row[on], np.arange(len(c.n_words) + 1))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if z > a:
            out[on[a:z]] = field.viterbi(c.features[on[a:z]])
    return out


def labelled_lines(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, line (from 0), content: one row for each line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            c = counted(batch.column(1))
            label = decoded(field, c)
            on = np.flatnonzero(c.line_words)
            at = on - np.searchsorted(c.line_row, c.line_row[on])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c.line_row[on])), pa.array(at), pa.array(label[on])], ["doc_id", "line", "content"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, line long, content boolean")


def quality_rules(docs: DataFrame, field: Field, *, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_lines, n_content_lines, content_share: one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            c = counted(batch.column(1))
            label = decoded(field, c)
            sums = lambda w: np.bincount(c.line_row, weights=w, minlength=batch.num_rows).astype(np.int64)  # noqa: B023, E731
            content = sums(c.line_chars * label)
            failed = (c.n_words < LEAST_WORDS) | (100 * c.n_repeat_words > REPEATED_PERCENT * c.n_words)
            part = content / np.maximum(c.word_chars, 1)
            longs = [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x.astype(np.int64)) for x in longs], pa.array(failed), pa.array(~failed & (part >= share)), pa.array(sums(c.line_words > 0)), pa.array(sums(label)), pa.array(part)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share"],
            )

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
