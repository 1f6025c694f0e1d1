"""Packing, token counts, pieces and media: exact against the libraries, round trips."""

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import common, media, packing, pieces, tokencount
from tidewatch.llm.common import tokenizer_path

ALPHABET = list("aAbZ 'sStm\t\n\x1c\x85\xa0éÉΣς1٣<|>_-.,​ﬁ漢😀") + ["́", "<|endoftext|>", "<|startoftext|>", "'re", "'LL", "  ", "the ", "ing"]


def texts(n, size, seed):
    random.seed(seed)
    return ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(packing.TOKENIZER)), Tokenizer.from_file(tokenizer_path(tokencount.TOKENIZER)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))


def test_ids_are_the_library_s(libraries):
    ids = packing.WordIds(tokenizer_path(packing.TOKENIZER))
    for t in texts(3000, 16, 1) + ["word " * 300_000]:
        assert np.frombuffer(ids.encode(t), "<u4").tolist() == libraries[0].encode(t, add_special_tokens=False).ids


def test_counts_are_the_library_s_at_every_prefix(libraries):
    c = tokencount.Counter(tokenizer_path(tokencount.TOKENIZER))
    for t in texts(3000, 16, 2) + ["aé" * 3000, "word  " * 250_000]:
        assert c.count(t) == len(libraries[1].encode(t, add_special_tokens=False).ids)
    for t in texts(300, 14, 3):
        if "<" not in t:
            table = c.table(t)
            assert [table.count(i) for i in range(len(t) + 1)] == [len(libraries[1].encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_budgets(libraries):
    c = tokencount.Counter(tokenizer_path(tokencount.TOKENIZER))
    text = "some words, and more of them: 12345 " * 30
    table = c.table(text)
    cut = table.longest_within(40)
    assert table.over(40) and 0 < cut < len(text) and c.count(text[:cut]) <= 40
    assert table.longest_within(10**6) == len(text)


def test_the_longest_prefix_within_a_budget_against_all_prefixes(libraries):
    c = tokencount.Counter(tokenizer_path(tokencount.TOKENIZER))
    runs = ["\n" * 200 + "x", "a" * 300 + " b", "'" * 160 + "s x", " \n\n  it's 're  \t x"]
    for t in texts(150, 14, 11) + runs:
        every = [len(libraries[1].encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        for budget in {0, 1, 2, 5, every[-1] // 2, every[-1]}:
            assert c.measured(t, budget) == (every[-1], max(i for i, n in enumerate(every) if n <= budget)), (t, budget)


def test_a_budget_in_a_text_of_many_parts(monkeypatch):
    c = tokencount.Counter(tokenizer_path(tokencount.TOKENIZER))
    text = "several words of text, no more than 12 of them " * 400
    want = c.measured(text, 3000)
    monkeypatch.setattr(tokencount, "PART_CHARS", 500)
    assert len(list(tokencount.parts(text))) > 20 and c.measured(text, 3000) == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokencount.settings(tokenizer_path(packing.TOKENIZER))
    assert tokencount.settings(tokenizer_path(tokencount.TOKENIZER)) == (tokencount.BYTE_LEVEL, ["<|endoftext|>"])


def test_learned_entries_stay_within_their_bytes(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(common, "LEARNED_BYTES", 4 << 20)
    random.seed(3)
    for model in (packing.WordIds(tokenizer_path(packing.TOKENIZER)), tokencount.Counter(tokenizer_path(tokencount.TOKENIZER)), pieces.Pieces(tokenizer_path(pieces.MODEL))):
        tracemalloc.start()
        most = 0
        for _ in range(12):
            model.learn({"".join(random.choices("abcdefgh", k=9)) for _ in range(4000)})
            most = max(most, tracemalloc.get_traced_memory()[0])
        tracemalloc.stop()
        assert 1 << 20 < most < 3 * (4 << 20)  # the bound, and the chunk that passed it
        model.forget()


def test_a_worker_holds_one_model():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of text"])], ["doc_id", "text"])
    list(packing.pieces_of(iter([batch]), tokenizer_path(packing.TOKENIZER), 2048, 0, False))
    assert [k[0] for k in common._held] == ["words"]
    list(tokencount.counted(iter([batch]), tokenizer_path(tokencount.TOKENIZER), 512))
    assert [k[0] for k in common._held] == ["counts"]


def test_pieces_are_the_library_s(libraries):
    p = pieces.Pieces(tokenizer_path(pieces.MODEL))
    sample = texts(1500, 24, 4) + ["▁▁ a▁b", "<s></s><0x41>", "word  " * 1000]
    p.learn({w for t in sample for part in p.marked(t) for w in pieces._chunks(part)})
    for t in sample:
        ids = p.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == libraries[2].encode(t), t
        assert p.decode(ids) == libraries[2].decode(libraries[2].encode(t))


def test_suffix_order():
    random.seed(0)
    s = "".join(random.choice("abc") for _ in range(500))
    order = pieces.suffix_ranks(np.frombuffer(s.encode(), np.uint8).astype(np.int64), 16)
    assert [s[i : i + 16] for i in order] == sorted(s[i : i + 16] for i in range(500))


def test_piece_frames(spark):
    df = spark.createDataFrame([(1, "the éé 漢", 1), (2, None, 1), (None, "x", 1)], "doc_id long, text string, n_pieces int")
    got = pieces.encode(df, with_ids=True)
    assert all(r["round_trip"] for r in got.collect())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(got).collect()}
    assert back == {1: "the éé 漢", 2: "", None: "x"}
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- packing -------------------------------------------------------------------------------


def test_fullest_combination_against_brute_force():
    random.seed(0)
    for _ in range(60):
        counts = np.zeros(41, np.int64)
        for _ in range(random.randint(0, 4)):
            counts[random.randint(1, 40)] += random.randint(1, 3)
        slack = random.randint(0, 40)
        there = np.flatnonzero(counts).tolist()
        best = max((sum(k * n for k, n in zip(ks, there)) for ks in product(*[range(counts[n] + 1) for n in there]) if sum(k * n for k, n in zip(ks, there)) <= slack), default=0)
        used = packing.fullest(counts, slack)
        assert sum(k * n for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 2049, 5000), minlength=2049)
    plan = packing.plan(counts)
    used = np.zeros(2049, np.int64)
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern.items()) <= 2048
        for n, k in pattern.items():
            used[n] += k * times
    assert (used == counts).all()
    least = -(-int((np.arange(2049) * counts).sum()) // 2048)
    assert sum(t for _, t in plan) <= least * 1.01 + 1


def test_packed_rows(spark, libraries):
    random.seed(5)
    docs = [(i, random.choice(["", None, "a b", "word " * random.randint(1, 900), "x1 " * 3000])) for i in range(120)] + [(3, "repeat"), (3, "repeat"), (None, "no id")]
    rows = packing.best_fit(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, piece int")).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 2048) + 1
    ids = {i: [*libraries[0].encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs[:120] if i != 3}
    mine = {}
    for r in rows:
        if r["doc_id"] in ids:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
            mine[r["doc_id"]] = mine.get(r["doc_id"], 0) + r["length"]
    assert mine == {i: len(x) for i, x in ids.items()}
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_count_frames(spark):
    df = spark.createDataFrame([(1, "a" * 5000, 9), (2, None, 9), (2, "", 9), (None, "é", 9)], "doc_id long, text string, n_tokens int")
    got = sorted(((-1 if r[0] is None else r[0]), r[1], r[2] > 0, r[3]) for r in tokencount.token_counts(df).collect())
    assert got == [(-1, 2, True, False), (1, 5000, True, True), (2, 0, False, False), (2, 0, False, False)]
    cut = {r["doc_id"]: r["text"] for r in tokencount.truncated(spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string"), 2).collect()}
    assert cut == {1: "one two", 2: None}
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- media ---------------------------------------------------------------------------------


def test_media_round_trip_and_equal_texts(spark):
    rows = [(1, "hällo " * 500), (2, "hällo " * 500), (3, None), (4, ""), (5, "a" * 192), (6, "z" * 193)]
    got = {r["doc_id"]: r for r in media.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        data = (t or "").encode()
        pad = data + b" " * ((-len(data)) % 192 if data else 192)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
    assert got[1]["feature"] == got[2]["feature"] and got[1]["media_sha256"] == got[2]["media_sha256"] != got[5]["media_sha256"]
    assert media.from_wav(media.to_wav(b"abcd")) == b"abcd"


def test_blocks_join_without_a_seam():
    x = np.random.default_rng(0).integers(0, 256, media.BLOCK + 192 * 7, dtype=np.uint8)
    assert (media.mel_frames(x) == media.all_frames(x)).all()


def test_frames_hold_the_tail():
    one, two = (("ab c" * 96)[:-40] + tail for tail in ("x" * 40, "A~" * 20))
    a, b = (media.all_frames(np.frombuffer(media.payload_of(t), np.uint8)) for t in (one, two))
    assert len(one) == 384 and len(a) == 2 and media.feature(a, []) != media.feature(b, [])
    rng = np.random.default_rng(1)
    for units in (1, 2, 5, 8, 9):
        x = rng.integers(0, 256, media.BLOCK // media.UNIT * media.UNIT + units * media.UNIT).astype(np.uint8)
        whole = media.mel_frames(x)
        assert (len(whole) - 1) * media.HOP + media.WINDOW >= len(x) * media.UP // media.DOWN
        assert (whole == media.all_frames(x)).all()


def test_hysteresis_segments():
    frames = np.zeros((10, 2), np.float32)
    frames[3:6] = 1.0
    assert media.segments(frames) == [(3, 6)]
    assert media.segments(np.zeros((4, 2), np.float32)) == []


def test_tensors(spark):
    t = media.tensors(spark.createDataFrame([(1, "speech " * 9000), (2, None)], "doc_id long, text string")).toPandas()
    mel = pa.array(t["mel"].tolist(), pa.list_(pa.float32()))
    tensor = media.as_tensor(mel)
    assert tensor.type == media.tensor_type() and tensor.to_numpy_ndarray().shape == (len(t), media.TENSOR_FRAMES, media.BANDS)
    assert (t["end_s"] > t["begin_s"]).all()


def test_resampling_against_its_definition():
    rng = np.random.default_rng(2)
    x = rng.normal(size=200).astype(np.float32)
    n = media.UP * media.TAPS
    h = np.sinc((np.arange(n) - (n - 1) / 2) / max(media.UP, media.DOWN)) * np.hamming(n)
    for phase in range(media.UP):
        h[phase :: media.UP] /= h[phase :: media.UP].sum()
    want = []
    for j in range(len(x) * media.UP // media.DOWN):
        taps = [(i, j * media.DOWN - i * media.UP + (media.TAPS // 2 - 1) * media.UP) for i in range(len(x))]
        want.append(sum(x[i] * h[k] for i, k in taps if 0 <= k < n))
    assert np.allclose(media.resample(x), want, atol=1e-5)


def test_mel_bands_against_a_plain_transform():
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 256, 960, dtype=np.uint8)
    got = media.mel_frames(samples)
    x = media.resample((samples.astype(np.float32) - 128) / 128).astype(float)
    x = np.concatenate([x, np.zeros(media.WINDOW + (len(got) - 1) * media.HOP - len(x))])
    e = media.mel_edges()
    assert len(e) == media.BANDS + 2 and (np.diff(e) > 0).all() and e[-1] <= media.WINDOW // 2 + 1
    for f in range(len(got)):
        frame = x[f * media.HOP : f * media.HOP + media.WINDOW] * np.hanning(media.WINDOW)
        t = np.arange(media.WINDOW)
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * t / media.WINDOW))) ** 2 for k in range(media.WINDOW // 2 + 1)]
        for b in range(media.BANDS):
            lo, peak, hi = e[b : b + 3]
            energy = sum(power[k] * ((k - lo) / (peak - lo) if k < peak else (hi - k) / (hi - peak)) for k in range(lo, min(hi, len(power))))
            assert abs(got[f, b] - np.log(energy + 1e-6)) < 1e-3


def test_hysteresis_against_a_state_machine():
    rng = np.random.default_rng(4)
    for _ in range(50):
        frames = rng.normal(0, 0.1, (rng.integers(1, 60), 3)).astype(np.float32)
        energy = frames.mean(axis=1)
        energy = energy - energy.mean()
        on, want, begin = False, [], 0
        for i, v in enumerate(energy):
            if not on and v > media.ENTER:
                on, begin = True, i
            elif on and v < media.LEAVE:
                on = False
                want.append((begin, i))
        assert media.segments(frames) == want + ([(begin, len(energy))] if on else [])


def test_the_digest_comes_from_tensors_and_spans():
    text = "speech and silence " * 3000
    rows = media.encoded(pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([text, None])], ["doc_id", "text"]))
    frames = media.all_frames(np.frombuffer(media.payload_of(text), np.uint8))
    mel, spans = rows.column(6)[0].values, rows.column(4)[0].values
    assert mel.type == media.tensor_type() and (media.frames_of(mel, spans) == frames).all()
    assert len(media.frames_of(rows.column(6)[1].values, rows.column(4)[1].values)) == 1
    d = media.digested(rows).to_pylist()
    found = [((a * media.STEP_S), ((z - 1) * media.STEP_S + media.FRAME_S)) for a, z in media.segments(frames)]
    assert d[0]["feature"] == media.feature(frames, found) and d[0]["n_tensors"] == len(mel) == -(-len(frames) // media.TENSOR_FRAMES)
    assert d[1]["n_bytes"] == 0 and d[1]["payload_bytes"] == 192


def test_media_edge_cases(spark):
    rows = [(None, "x", 1.0, "m"), (1, "same", 2.0, "m"), (1, "same", 2.0, "m"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature double, media string")
    got = media.digests(df).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in got) == [-1, 1, 1, 2] and len({r["feature"] for r in got if r["doc_id"] == 1}) == 1
    empty = df.limit(0)
    assert media.digests(empty).count() == media.tensors(empty).count() == media.media(empty).count() == 0
    assert media.from_wav(media.media(df.where("doc_id is null")).collect()[0]["media"]) == b"x" + b" " * 191
