"""Toxicity by a weighted lexicon and Aho-Corasick over folded texts.

Folding makes full-width and mathematical letters plain, lower-cases, maps look-alike letters and
digit substitutions to Latin letters, and turns everything else in ASCII into a space. Accents
stay, as they tell words of some languages apart; a word that only matches without its accents is
taken without them. Lexicon terms match at word starts (stems) or as whole words; matches inside
an exception phrase don't count. A text's weight sum and its length give
two statistics (the sum, and the sum per thousand words) which a small logistic model turns into
a score.

The lexicon's terms and weights are learned from a bounded sample of labelled rows: words and
word stems whose document frequencies among distinct texts differ by class (G statistic), weighted
by log odds; terms and totals are counted over the same distinct texts. A short built-in list
stands in where no toxic row is labelled.

Defined results: null and empty texts get the score of a text without matches; rows with a null
doc_id are scored, held_out false; very long texts are scored whole, in time that grows with the
text; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, crc_bucket, held, materialise, table
from tidewatch.llm.labelled import SAMPLE_ROWS, sample

#: Mild insults that stand in for a learned lexicon, and phrases in which they are harmless.
DEFAULT_LEXICON = {"idiot": 3.0, "moron": 3.0, "stupid": 2.0, "loser": 2.0, "scum": 2.5, "worthless": 2.0, "pathetic": 2.0, "disgusting": 2.0, "trash": 1.5}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pathetic fallacy", "idiot proof", "pond scum", "moron test pattern")
#: Look-alikes that no decomposition maps (Cyrillic, Greek, Latin, Armenian, Cherokee) and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "y",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϳ": "j",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ɩ": "i", "ʋ": "v", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ø": "o", "đ": "d", "ħ": "h", "ł": "l",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    "Ꭰ": "d", "Ꭱ": "r", "Ꭲ": "t", "Ꭵ": "i", "Ꭺ": "a", "Ꭻ": "j", "Ꭼ": "e", "Ꮃ": "w", "Ꮇ": "m", "Ꮋ": "h", "Ꮐ": "g", "Ꮓ": "z", "Ꮟ": "b", "Ꮤ": "w", "Ꮥ": "s", "Ꮩ": "v", "Ꮪ": "s", "Ꮮ": "l", "Ꮯ": "c", "Ꮲ": "p", "Ꮶ": "k",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Letters of a stem; a longer word than the last counts by its first letters only.
STEMS, LONGEST = range(4, 8), 39
#: Parameters of the learned lexicon: terms kept, candidates looked at (by evidence), least G statistic, largest share of clean documents.
TERMS, CANDIDATES, LEAST_G, CLEAN_SHARE = 4_000, 20_000, 20.0, 0.1

FOLD = {i: " " for i in range(128) if not chr(i).isalpha()} | {ord(k.lower()): v for k, v in (HOMOGLYPHS | DIGITS).items()} | dict.fromkeys((*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD))
FOLD_TABLE = str.maketrans({chr(k): v for k, v in FOLD.items()})


def fold(text: str) -> str:
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return f" {plain.lower().translate(FOLD_TABLE)} "


def without_accents(word: str) -> str:
    return unicodedata.normalize("NFKD", word).translate(FOLD_TABLE)


def unmasked(a, folded: str) -> str:
    """The folded text with words that match without their accents, and only so, written without them."""
    if folded.isascii():
        return folded
    matches = lambda w: any(end - size + 1 == 0 for end, (size, _, _) in a.iter(f" {w} "))
    words = folded.split()
    plain = {w: p for w in set(words) if not w.isascii() and (p := without_accents(w)) != w and matches(p) and not matches(w)}
    return f" {' '.join(plain.get(w, w) for w in words)} " if plain else folded


def terms_of(folded: str) -> set[str]:
    """' word ' (of longer ones their first letters) and ' stem' of all words of a folded text."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} " if len(w) <= LONGEST else f" {w[:LONGEST]}")
        out.update(f" {w[:n]}" for n in STEMS if n <= len(w))
    return out


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]


def automaton(terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    phrases, weights = {f" {' '.join(p.lower().split())}" for p in exceptions}, dict(terms)
    for s in phrases | weights.keys():
        a.add_word(s, (len(s), weights.get(s, 0.0), s in phrases))
    a.make_automaton()
    return a


def weight_sum(a, folded: str) -> float:
    """Weights of all matches that don't lie in an exception phrase, the largest of each word start.

    The furthest end of the phrases that start no later than a match tells whether one holds it.
    """
    found = list(a.iter(folded))
    phrases = sorted((end - size + 1, end + 1) for end, (size, _, phrase) in found if phrase)
    starts, furthest = [lo for lo, _ in phrases], list(accumulate((hi for _, hi in phrases), max))
    best: dict[int, float] = {}
    for end, (size, weight, _) in found:
        start = end - size + 1
        if weight > best.get(start, 0.0):
            i = bisect_right(starts, start)
            if not i or furthest[i - 1] < end:
                best[start] = weight
    return math.fsum(best.values())


def statistics(a, text: str | None) -> tuple[float, float]:
    if not text:
        return 0.0, 0.0
    s = weight_sum(a, unmasked(a, fold(text)))
    return (math.log1p(s), math.log1p(1000 * s / max(20, len(text.split())))) if s else (0.0, 0.0)


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label -> (term, toxic documents, clean documents) of the batch."""
    for batch in chunks(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label].update(terms_of(fold(text or "")))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0))], ["term", "toxic", "clean"])


def choose(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms by evidence; a term that a chosen stem already covers is left out."""
    odds = lambda a, b: math.log((a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_clean + 1)))
    ranked = sorted(rows, key=lambda r: (-round(r[1] * odds(r[1], r[2]), 6), -len(r[0]), r[0]))
    out: dict[str, float] = {}
    for term, a, b in ranked:
        if not any(term[: n + 1] in out for n in STEMS):
            out[term] = odds(a, b)
    return dict(list(out.items())[:TERMS])


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic coefficients (constant first) by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    beta, pen = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + pen, z.T @ (w * (y - p)) - pen @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Learn from training rows (crc32(doc_id) mod 5 is not 0); at most about ``rows`` of each class."""
    train = materialise(sample(docs, labels, "toxic", modulus=5, held_out=0, rows=rows), "toxic-sample")
    # one row a copy group: a passage that many copies share is not evidence of its words
    distinct = train.dropDuplicates(["label", "text"]).select("text", "label")
    sizes = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}  # two rows
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    lexicon: dict[str, float] = {}
    if n1 and n0:
        counts = distinct.mapInArrow(term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        a, b = F.col("a"), F.col("b")
        total = float(n1 + n0)
        part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        seen = a + b
        g = 2 * (part(a, seen * (n1 / total)) + part(b, seen * (n0 / total)) + part(n1 - a, (total - seen) * (n1 / total)) + part(n0 - b, (total - seen) * (n0 / total)))
        strong = counts.where(a > 2).where(a / n1 > 5 * b / n0).where(b <= CLEAN_SHARE * (a + b)).where(g >= LEAST_G)
        evidence = F.round(a * F.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))), 6)
        found = strong.orderBy(evidence.desc(), F.length("term").desc(), "term").limit(CANDIDATES).collect()  # a bounded lexicon
        lexicon = choose([(r["term"], r["a"], r["b"]) for r in found], n1, n0)
    if not lexicon:
        lexicon = {f" {w} ": v for w, v in DEFAULT_LEXICON.items()}
    terms = tuple(sorted(lexicon.items()))
    coefficients = np.array([-4.0, 1.0, 1.0])
    if n1 and n0:

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = automaton(terms, exceptions)
            for batch in chunks(batches):
                s = [statistics(a, t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in s]), pa.array([x for _, x in s]), batch.column(1), batch.column(2)], ["x1", "x2", "label", "weight"])

        got = train.select("text", "label", "weight").mapInArrow(features, "x1 double, x2 double, label int, weight double").toPandas()  # the bounded sample's numbers
        got = got.sort_values(["label", "x1", "x2", "weight"])
        w = got["weight"].to_numpy() / got["weight"].mean()
        coefficients = fit_logistic(got[["x1", "x2"]].to_numpy(), got["label"].to_numpy(float), w)
    return ToxicityModel(terms, exceptions, tuple(float(c) for c in coefficients))


def logits(batches: Iterator[pa.RecordBatch], model: ToxicityModel, column: int) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
    """The batches in chunks, with the log odds of each row's text."""
    c0, c1, c2 = model.coefficients
    with held(("lexicon", model), lambda: automaton(model.terms, model.exceptions)) as a:
        for batch in chunks(batches, column):
            yield batch, [c0 + c1 * x + c2 * y for x, y in (statistics(a, t) for t in batch.column(column).to_pylist())]


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, odds in logits(batches, model, 1):
            p = [1 / (1 + math.exp(-min(35.0, max(-35.0, z)))) for z in odds]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; same columns, an empty table stays empty."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, odds in logits(batches, model, at):
            yield batch.filter(pa.array([z < 0 for z in odds], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
