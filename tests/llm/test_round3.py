"""Spelling variants, hard negatives, quality rules: against plain versions."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hardnegatives as H
from tidewatch.llm import linelabels as L
from tidewatch.llm import oracles
from tidewatch.llm import variants as V

# --- spelling variants ---------------------------------------------------------------------


def plain_counts(rows, letters=V.LETTERS, deleted=V.DELETED):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % deleted == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= letters:
                out[word] += 1
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        was, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            was, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, was + (x != y))
    return row[-1]


def plain_variants(counts, factor=V.FACTOR):
    near = {w: [x for x in counts if edits(w, x) == 1] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def found(words, **kw):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in V.variants(words, **kw).collect()}


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_variants_against_all_pairs(spark, group):
    random.seed(group)
    words = {"".join(random.choice("abé") for _ in range(random.randint(6, 9))) for _ in range(160)} | {"aaaaaa", "aaaaaaa", "baaaaaa", "aaaaaab", "x" * 60, "x" * 61, "x" * 30 + "y" + "x" * 30}
    counts = {w: random.choice([5, 6, 25, 130, 700]) for w in words}
    assert found(spark.createDataFrame(list(counts.items()), "word string, n long"), group=group) == plain_variants(counts)


def test_hot_segments_are_parted_and_not_joined(spark):
    words = [f"{'common'}{a}{b}{c}" for a, b, c in itertools.product("abcdefgh", repeat=3)]
    counts = {w: 5 for w in words}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {frozenset((r["a"], r["b"])) for r in V.near_pairs(rows, group=8).collect()}
    assert got == {frozenset(p) for p in itertools.combinations(words, 2) if sum(x != y for x, y in zip(*p)) == 1}


def test_word_counts_over_whole_texts(spark, monkeypatch):
    random.seed(2)
    rows = [(i if i % 9 else None, " ".join(random.choice(["Letters", "LETTERS", "Étéréè", "ab", "abcdefg1hijklmn", "x×yzabc", "12"]) for _ in range(400))) for i in range(30)] + [(100, None), (101, ""), (102, "abcdefghij" * 300)]
    monkeypatch.setattr(V, "HELD_WORDS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("word", F.lit(1))
    for deleted in (3, 199):
        got = {r["word"]: r["n"] for r in V.word_counts(docs, deleted=deleted).collect()}
        assert got == plain_counts(rows, deleted=deleted)
    assert "".join(V.parts("ab cd" * 50, 7)) == "ab cd" * 50 and all(re.match(r"\W|^", p) for p in V.parts("abcdef ghi", 2))
    assert V.word_counts(docs.limit(0)).count() == 0 and V.variants(V.word_counts(docs.limit(0))).count() == 0


def test_forms_lead_to_roots(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 9, "aaaabc": 125}
    got = {r[0]: r for r in found(spark.createDataFrame(list(counts.items()), "word string, n long"))}
    assert got["aaaaaa"][1:3] == ("aaaaab", "aaabbb") and got["zzzzzz"][1:] == (None, "zzzzzz", 9, 0, None)
    assert got["aaaaab"][1] == "aaaabb"  # ties of two forms: the smaller word


def test_spelling_sql_agrees(spark, tmp_path):
    from tidewatch.llm.registry import queries

    random.seed(5)
    vocabulary = ["".join(random.choice("aÉT") for _ in range(7)) for _ in range(90)]
    weights = [random.choice([1, 8, 60]) for _ in vocabulary]
    rows = [(i if i else None, " ".join(random.choices(vocabulary, weights, k=random.randint(0, 90))) if i % 11 else None) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql(f"select word, form, root, n, n_near, form_n from ({oracles.OP11})").fetchall()}
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries()["op11_spelling_variants"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 50 and any(r[1] for r in want)


# --- hard negatives ------------------------------------------------------------------------


def plain_negatives(rows, every=10, k=H.K):
    """rows: (id, label, vector)."""
    able = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * x)) for x in v]
        able[i] = min(able.get(i, (label, w)), (label, w))
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(able[a][1], able[b][1], strict=True))
    for a in able:
        if a % every:
            continue
        others = [b for b in able if b != a and len(able[b][1]) == len(able[a][1])]
        alike = sorted((b for b in others if able[b][0] == able[a][0]), key=lambda b: (-score(a, b), b))[:k]
        for p in alike:
            ps = score(a, p)
            own = sorted((b for b in others if able[b][0] != able[a][0] and 80 * ps <= 100 * score(a, b) <= 100 * ps), key=lambda b: (-score(a, b), b))[:k]
            out |= {(a, p, r, b, ps, score(a, b)) for r, b in enumerate(own, 1)}
    return out


def mined(spark, rows, **kw):
    t = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit("x"), "g": F.lit(1), "score": F.lit(2)})
    return {tuple(r) for r in H.hard_negatives(t, F.pmod("id", F.lit(10)) == 0, F.col("label"), **kw).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def vectors(n, dim, seed, labels=4, step=8):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)) if i % 3 else 1, (np.round(rng.normal(1, 1, dim) * step) / step).tolist()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"anchors": 3, "candidates": 7}])
def test_hard_negatives_against_brute_force(spark, sizes):
    # several chunks of dimensions, several blocks, a hot label, ties
    rows = vectors(180, 5, 1, step=2) + [(1000 + i, 2, (np.ones(70) * (i % 3)).tolist()) for i in range(20)] + [(1100 + i, 3, (np.ones(70) * (i % 4) * 0.9).tolist()) for i in range(15)]
    assert mined(spark, rows, **sizes) == plain_negatives(rows) != set()


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 4, 2, labels=2)
    rows += [(None, 1, [1.0] * 4), (200, None, [1.0] * 4), (210, 1, None), (220, 1, []), (230, 1, [1.0, nan, 1.0, 1.0]), (240, 1, [inf, 1.0, 1.0, 1.0]), (250, 1, [None, 1.0, 1.0, 1.0])]
    rows += [(300, 7, [1.0] * 4), (310, 1, [1.0] * 3), (0, 0, [2.0] * 4), (20, 1, [-3.0] * 4), (20, 1, [-3.0] * 4), (400, 0, [0.0] * 4)]
    assert mined(spark, rows) == plain_negatives(rows) != set()
    assert mined(spark, rows[:0]) == set() and mined(spark, [(1, 1, [1.0])]) == set() and mined(spark, [(0, 1, [1.0])]) == set()
    # a vector too long for 64-bit scores takes no part
    assert mined(spark, [*rows, (500, 1, [1e200] * 4)]) == plain_negatives(rows)


def test_large_integers_are_exact(spark):
    a, b = 2.0**20 + 1 / 256, 2.0**20
    rows = [(0, 1, [a, a, 1.0]), (1, 1, [a, b, 2.0]), (2, 1, [b, a, 3.0]), (3, 2, [b, b, 1.0]), (4, 2, [a, b, 1.0])]
    assert mined(spark, rows) == plain_negatives(rows) != set()


def test_windows_and_best_of_a_strip():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.integers(-5, 6, rng.integers(1, 30))
        for k in (1, 3, 50):
            assert H.best(s, k).tolist() == sorted(range(len(s)), key=lambda i: (-s[i], i))[:k]


def test_hard_negative_sql_agrees(spark, tmp_path):
    from tidewatch.llm.registry import queries

    rows = [(i, lab, v) for i, lab, v in vectors(700, 6, 4, labels=3)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = {tuple(r) for r in con.sql(f"select {names} from ({oracles.OP12})").fetchall()}
    got = {tuple(r) for r in queries()["op12_hard_negatives"](spark, str(tmp_path)).select(*names.split(", ")).collect()}
    assert got == want and len(want) > 20


# --- quality rules -------------------------------------------------------------------------


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] >= 2:
            covered.update(range(i, i + 5))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def mixed_texts(n):
    pieces = ["a", "b ", "a b ", "\n", "# ", "é", "x y z w v ", "\t", " ", "\r\n", "!!", "|", "𝄞 "]
    return [random.choice([None, "", "\n", "\n\n", "a", " "]) if random.random() < 0.3 else "".join(random.choices(pieces, k=random.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 20, 7, 64])
def test_base_counts_against_plain_ones(block, monkeypatch):
    random.seed(block)
    monkeypatch.setattr(L, "BLOCK", block)
    for _ in range(60):
        texts = mixed_texts(random.randint(1, 8))
        c = L.counted(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert (c.n_words[i], c.word_chars[i], c.n_symbols[i], c.n_dup_lines[i], c.n_repeat_words[i]) == plain_base(t)[:5], t
        assert len(c.line_row) == sum((t or "").count("\n") + 1 for t in texts)


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        x = np.column_stack([rng.normal(size=(n, 2)), np.zeros((n, len(L.FEATURES) - 2))])
        field = L.Field((1.0, -0.5) + (0.0,) * (len(L.FEATURES) - 2), float(rng.normal()), tuple(map(tuple, rng.normal(size=(2, 2)).tolist())))
        gain = x @ np.array(field.weights)
        score = lambda y: sum(g for g, on in zip(gain, y) if on) + y[0] * field.first + sum(field.steps[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert field.viterbi(x).astype(int).tolist() == list(best)


def test_likelihood_and_gradient_against_sums_over_labellings():
    rng = np.random.default_rng(2)
    n, length, f = 5, 4, 3
    x, y = rng.normal(size=(n, length, f)), (rng.random((n, length)) < 0.5) * 1.0
    sizes, weight, theta = np.array([4, 1, 2, 3, 4]), rng.random(n), rng.normal(size=f + 5)
    mask = np.arange(length)[None] < sizes[:, None]

    def plain(th):
        total = 0
        for i in range(n):
            gain, steps = x[i] @ th[:f], th[f + 1 :].reshape(2, 2)
            score = lambda z: sum(g for g, on in zip(gain, z) if on) + z[0] * th[f] + sum(steps[a, b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            own = tuple(y[i, : sizes[i]].astype(int))
            total += weight[i] * (score(own) - np.log(sum(np.exp(score(z)) for z in itertools.product((0, 1), repeat=int(sizes[i])))))
        return total / weight.sum()

    value, grad = L.likelihood(theta, x, y, mask, weight)
    assert value == pytest.approx(plain(theta))
    numeric = [(plain(theta + 1e-6 * e) - plain(theta - 1e-6 * e)) / 2e-6 for e in np.eye(f + 5)]
    assert np.allclose(grad, numeric, atol=1e-7)


def sentences(rng, n):
    return " ".join(rng.choice(["the", "river", "walked", "over", "stone,", "again.", "while", "people", "spoke"]) + rng.choice(["", "", "er", "ly"]) for _ in range(n)).capitalize() + "."


def labelled(n=400):
    rng, rows = random.Random(7), []
    for i in range(n):
        good = i % 3 > 0
        lines = [sentences(rng, rng.randint(20, 40)) for _ in range(rng.randint(4, 6))]
        junk = [" ".join(f"{w}###" for w in sentences(rng, rng.randint(12, 40)).split()) for _ in range(rng.randint(3, 6))]
        text = "\n".join([*lines, *junk[:1]] if good else [*lines[:1], *junk])
        rows.append((i, text, int(good)))
    return rows


def test_kept_follows_the_content_share_on_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x", True) for i, t, _ in rows] + [(None, None, "x", True), (9001, "", "x", True), (9002, "\n \n", "x", True), (9003, rows[1][1], "x", True), (9003, rows[1][1], "x", True)], "doc_id long, text string, n_words string, kept boolean")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    field = L.fit(docs, labels)
    got = L.quality_rules(docs, field).collect()
    by_id = {r["doc_id"]: r for r in got}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1 and not by_id[i]["base_failed"]]
    assert sum(by_id[i]["kept"] == bool(q) for i, q in held) >= 0.99 * len(held) > 50
    for i, t, _ in rows:
        r = by_id[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_base(t)
    assert not by_id[9001]["kept"] and by_id[9002]["n_lines"] == 0 and by_id[None]["base_failed"]
    assert len([r for r in got if r["doc_id"] == 9003]) == 2 and len(got) == len(rows) + 5
    # labels of held-out rows are not learned from
    other = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, _, q in rows], "doc_id long, quality int")
    assert L.fit(docs, other) == field
    lines = L.labelled_lines(docs, field).where("doc_id = 1").orderBy("line").collect()
    assert [r["line"] for r in lines] == list(range(len(rows[1][1].split("\n")))) and [r["content"] for r in lines] == [True] * (len(lines) - 1) + [False]


def test_without_training_rows_every_line_is_content(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven\n### ### ###")], "doc_id long, text string")
    field = L.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert field == L.NO_FIELD and L.quality_rules(docs, field).first()["kept"] and L.quality_rules(docs.limit(0), field).count() == 0


def test_a_long_text_is_counted_in_blocks():
    import tracemalloc

    text = ("word another #word\n" * 60_000 + "x" * 3_000_000 + " " + "éa " * 200_000)[:6_000_000]
    tracemalloc.start()
    c = L.counted(pa.array([text, "a b", text[:50]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (c.n_words[0], c.word_chars[0], c.n_symbols[0], c.n_dup_lines[0], c.n_repeat_words[0]) == plain_base(text)[:5] and c.n_words[1] == 2
    assert peak < 40 * len(text.encode())
