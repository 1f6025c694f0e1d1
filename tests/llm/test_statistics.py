"""The sixteen statistics of a document, against a plain version."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import quality as Q


def plain(text):
    data = (text or "").encode()
    size, total = len(data), max(len(data), 1)
    kinds = Counter(int(Q.CLASS[b]) for b in data)
    fold = lambda b: bytes(x + 32 if 65 <= x < 91 else x for x in b)
    words = [fold(w) for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    lines = [fold(re.sub(rb"[\x00-\x09\x0b-\x20]", b"_", x)) for x in data.split(b"\n") if x]
    pairs = list(zip(words, words[1:]))
    n = len(words)
    share = lambda x, y: (x / max(y, 1)) ** 0.5
    return [
        np.log1p(size), *(share(kinds[k], total) for k in (1, 2, 4, 5, 6, 7, 8, 9)), np.log1p(size / max(n, 1)), np.log((len(set(words)) + 1) / (n + 1)) - np.log(max(n, 1.0) ** -0.3),
        share(len(lines) - len(set(lines)), len(lines)), np.log1p(len(lines)), share(max(Counter(words).values(), default=0), n), share(data.count(b"!"), total), share(len(pairs) - len(set(pairs)), len(pairs)),
    ]


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
def test_statistics_against_a_plain_version(block, monkeypatch):
    from tidewatch.llm import linelabels

    random.seed(block)
    monkeypatch.setattr(Q, "BLOCK", block)
    monkeypatch.setattr(linelabels, "BLOCK", block)
    pieces = ["a", "A b ", "the ", "\n", "\n\n", "é", "12", "!", "?", "(x)", "\t", "\x01", "###", " ", "same line\n", "Same Line\n"]
    for _ in range(40):
        texts = [random.choice([None, "", "\n", " "]) if random.random() < 0.2 else "".join(random.choices(pieces, k=random.randint(0, 60))) for _ in range(random.randint(1, 7))]
        got = Q.statistics(pa.array(texts, pa.string()))
        assert got.shape == (len(texts), len(Q.FEATURES))
        for x, t in zip(got, texts):
            assert np.allclose(x, plain(t)), t


def test_a_long_text_takes_bounded_memory():
    text = "some Words here, again\n" * 400_000  # 9 MB
    col = pa.array([text])
    tracemalloc.start()
    Q.statistics(col)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(text)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score(docs, Q.fit(docs, labels)).count() == 0
