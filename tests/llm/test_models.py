"""Classifiers, search and the pipeline."""

import random
import zlib

import numpy as np

from tidewatch.llm import quality, topk, toxicity
from tidewatch.llm.registry import oracle_sql, queries

CLEAN = [f"{a}{b}" for a in ("re", "th", "on", "er", "at", "in") for b in ("ble", "tion", "ing", "ed", "ly", "ness", "ment", "ous")]
BAD = ["grobnak", "plimfud", "zwertle"]


def held(i, m, k):
    return zlib.crc32(str(i).encode()) % m == k


def corpus(spark, n=700):
    random.seed(0)
    docs, labels = [], []
    for i in range(n):
        toxic, good = int(i % 5 == 0), int(i % 3 != 0)
        w = [random.choice(CLEAN) for _ in range(random.randint(5, 120))]
        if toxic:
            for _ in range(3):
                w.insert(random.randrange(len(w)), random.choice(BAD) + random.choice(["", "s", "isch"]))
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        docs.append((i, text, "en"))
        labels.append((i, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (g, t) for i, g, t in labels}


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]][1] for r in out) / len(out) > 0.97
    kept = {r["doc_id"] for r in toxicity.reject_toxic(docs, model).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels, truth = corpus(spark, 300)
    flipped = spark.createDataFrame([(i, 1 - g if held(i, 3, 1) else g, 1 - t if held(i, 5, 0) else t) for i, (g, t) in truth.items()], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert all((x == y).all() for x, y in zip(a.means + a.factors, b.means + b.factors))


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T, слоwn").split()[0] == "idiot"
    a = toxicity.automaton(((" clown", 2.0), (" scum ", 1.0)), ("clown fish",))
    s = lambda t: toxicity.weight_sum(a, toxicity.fold(t))
    assert s("a cl0wn") == 2 and s("Clown Fish!") == 0 and s("scummy") == 0 and s("scum clowns clown fish") == 3 and s("") == 0


def test_look_alikes_fold_to_plain_letters():
    for text in ("𝐢𝐝𝐢𝐨𝐭", "ｉｄｉｏｔ", "ᎥᎠᎥօt", "1d\u200b10t", "İDIOT", "id̈iot"):
        assert toxicity.fold(text) == " idiot ", text


def test_accents_hide_no_term_and_tell_words_apart():
    a = toxicity.automaton(((" idiot", 2.0), (" réeux", 1.0)), ("idiot proof",))
    s = lambda t: toxicity.weight_sum(a, toxicity.unmasked(a, toxicity.fold(t)))
    assert s("un ídiôt réeuxle") == 3 and s("reeux") == 0 and s("ídiot proof") == 0 and s("idiöts") == 2 and s("éé ñ") == 0


def test_weight_sum_against_brute_force():
    random.seed(4)
    terms = {" ab": 1.0, " abc": 2.0, " b ": 0.5, " abcd ": 3.0, " c": 0.25}
    phrases = ("ab b", "abc c ab", "c")
    a = toxicity.automaton(tuple(sorted(terms.items())), phrases)
    for _ in range(400):
        folded = toxicity.fold("".join(random.choice(["ab", "abc", "abcd", "b", "c", " ", " ", "x"]) for _ in range(random.randint(0, 30))))
        excused = [(i, i + len(p) + 1) for p in phrases for i in range(len(folded)) if folded.startswith(f" {p}", i)]
        best = {}
        for t, w in terms.items():
            for i in range(len(folded)):
                if folded.startswith(t, i) and not any(lo <= i and i + len(t) <= hi + 1 for lo, hi in excused):
                    best[i] = max(best.get(i, 0), w)
        assert toxicity.weight_sum(a, folded) == sum(best.values()), folded


def test_scoring_time_grows_with_the_text():
    import time

    a = toxicity.automaton(tuple((f" {w} ", v) for w, v in sorted(toxicity.DEFAULT_LEXICON.items())), toxicity.EXCEPTIONS)
    text = "trash can scum " * 70_000
    began = time.process_time()
    assert toxicity.weight_sum(a, toxicity.fold(text)) == 2.5 * 70_000
    assert time.process_time() - began < 2


def test_copies_are_not_evidence(spark):
    docs, labels, truth = corpus(spark, 300)
    copies = [(1000 + i, "zorble passage of a clean text", "en") for i in range(200)] + [(2000 + i, "vexil passage of a toxic text", "en") for i in range(40)]
    more = spark.createDataFrame([(i, 1, int(i >= 2000)) for i, *_ in copies], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.union(spark.createDataFrame(copies, docs.schema)), labels.union(more))
    assert not any("vexil" in t for t, _ in model.terms) and any("grob" in t for t, _ in model.terms)


def test_toxicity_of_empty_tables_and_clashing_names(spark):
    docs, labels, _ = corpus(spark, 300)
    model = toxicity.fit(docs, labels)
    rows = [(1, None, 0.5, True), (1, None, 0.5, True), (None, "grobnak plimfud zwertle " * 3, 0.1, False)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean")
    kept = toxicity.reject_toxic(odd, model)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [1, 1]
    assert toxicity.reject_toxic(odd.limit(0), model).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    out = [r for r in got if r["held_out"]]
    assert out and all(r["held_out"] == held(r["doc_id"], 3, 1) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]][0] for r in out) / len(out) > 0.97


def test_discriminant_is_the_gaussian_log_ratio():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(2, 2, (300, 3))])
    y = np.repeat([0, 1], 300)
    m = quality.fit_arrays(x, y, np.ones(600))
    want = []
    for k in (0, 1):
        cov = m.factors[k] @ m.factors[k].T
        d = x - m.means[k]
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(0.5))
    assert np.allclose(np.sinh(m.difference(x)), want[1] - want[0])


def test_classifiers_without_labels_and_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x y", 1.0), (None, None, 2.0), (2, "", 3.0), (2, "", 3.0), (3, "\x00 é " * 50000, 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for m in (toxicity, quality):
            rows = m.score(docs, m.fit(docs, labels)).collect()
            assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
            assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


# --- search --------------------------------------------------------------------------------


def brute_top(rows, k):
    v = {}
    good = [(i, [int(np.floor(64 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e)]
    for q, a in good:
        if q % 20 == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b)))[:k]
            v[q] = [(r + 1, c, -n) for r, (n, c) in enumerate(s)]
    return v


def test_top_k_against_all_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, rng.choice([0.1, 1, 5]), 6), 1)]) for i in range(400)]
    rows += [(1000, None), (1020, []), (1040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6), (1100, [1.0, 2.0]), (1101, [3.0, 1.0]), (None, [1.0] * 6), (500, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in topk.top_k(df, F.pmod("id", F.lit(20)) == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in brute_top(rows, 20).items() if x}
    assert topk.top_k(df.limit(0), F.pmod("id", F.lit(20)) == 0).count() == 0


def test_large_components_stay_exact():
    q = np.array([[2.0**40, 1.0]])
    c = np.array([[2.0**40, 0.0], [2.0**40, 1.0]])
    rows = topk.best_of(np.array([1]), q, np.array([-np.inf]), np.array([2, 3]), c, np.eye(2), 2)
    assert sorted(zip(rows[1], rows[2])) == [(2, 2**80), (3, 2**80 + 1)]


def test_short_vectors_are_not_sent_to_queries_that_need_long_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * (20 if i % 10 == 0 else 0.05)).tolist()) for i in range(900)]
    rows += [(1000, [0.0] * 6), (1010, None), (1020, (rng.normal(size=6) * 1e-3).tolist())]
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, topk.F.pmod("id", topk.F.lit(10)) == 0, k=5).collect()]
    assert sorted(got) == sorted(x for x in brute_top_of(rows, 5, 10))

def brute_top_of(rows, k, modulus):
    good = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows if e is not None]
    for q, a in good:
        if q % modulus == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(best))


def test_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(700)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), topk.F.pmod("id", topk.F.lit(100)) == 0, k=3).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == sorted((q, c) for q in range(0, 700, 100) for c in [x for x in range(4) if x != q][:3])


# --- registry and pipeline -----------------------------------------------------------------


def test_registry_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs, labels, truth = corpus(spark, 300)
    passage = "this passage of many words repeats across documents and should stay in the first of them alone"
    rows = [(r["doc_id"], r["text"], "en", "src", len(r["text"])) for r in docs.collect()]
    copy = " ".join(CLEAN) + " and some more words of its own here"
    rows += [(1000, copy, "en", "s", 0), (1001, copy.replace("here", "there"), "en", "s", 0), (1002, "a\n" + passage, "en", "s", 0), (1003, passage + "\nb", "en", "s", 0), (1004, "my token=abcdefgh1234", "en", "s", 0), (1005, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cols = table.columns
    a = P.STAGES[0][1](spark, table, str(tmp_path)).cache()
    ids = {r["doc_id"] for r in a.collect()}
    assert a.columns == cols and not {i for i, (_, t) in truth.items() if t and i in ids} and {i for i, (_, t) in truth.items() if not t} <= ids and {1000, 1005} <= ids
    b = P.STAGES[1][1](spark, a, str(tmp_path)).cache()
    text = {r["doc_id"]: r["text"] for r in b.collect()}
    assert b.columns == cols and text.keys() == ids and text[1002] == "a\n" + passage and text[1003] == "b" and text[1005] is None
    c = P.STAGES[2][1](spark, spark.createDataFrame(rows, table.schema), str(tmp_path))
    left = {r["doc_id"] for r in c.collect()}
    assert c.columns == cols and 1000 in left and 1001 not in left and 1002 in left
    d = P.STAGES[3][1](spark, b, str(tmp_path))
    assert d.columns == cols and {r["doc_id"]: r["text"] for r in d.collect()}[1004] == "my [SECRET]"
    e = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in e} <= ids and all(r["offset"] + r["length"] <= 2048 for r in e)
