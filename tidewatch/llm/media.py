"""Media columns: texts as 8-bit audio, with log-mel features and energy segments.

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the samples of a mono
8-bit WAV file, so the stored form is lossless. The stored bytes are read back, resampled by a
polyphase filter (3/2, windowed sinc), cut into overlapping frames, turned into log energies of
overlapping triangular mel bands and segmented by a hysteresis on the frames' energy. The frames
are kept as fixed-shape Arrow tensors, each with its time span, the segments as time spans; the
digest is taken from the stored file, the tensors and the spans.

All arithmetic runs text by text in a fixed order, so equal texts give equal values.

Defined results: null counts as empty (192 bytes of padding); long texts are read in blocks of
bounded size with the filter's overlap; a null doc_id stays null; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, table

UNIT, RATE = 192, 8_000
#: Polyphase resampling: up, down, taps for each phase.
UP, DOWN, TAPS = 3, 2, 8
#: Frames: window and hop in resampled samples; mel bands; frames in one tensor.
WINDOW, HOP, BANDS, TENSOR_FRAMES = 512, 256, 16, 32
#: Hysteresis over a frame's energy against the text's mean: enters above, leaves below, in natural-log units.
ENTER, LEAVE = 0.05, -0.05
#: Payload bytes that one block of frames reads.
BLOCK = 1 << 20


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * ((-len(data)) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    """A mono 8-bit PCM file; payloads are even, so no pad byte follows."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def from_wav(stored: bytes) -> bytes:
    """The data chunk of a file of ``to_wav``'s kind."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def filters() -> np.ndarray:
    """UP phases x TAPS of a Hamming-windowed sinc."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    h = h.reshape(TAPS, UP).T[:, ::-1]
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: output j is phase (j * DOWN) % UP at input (j * DOWN) // UP."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS, np.float32)])
    out = np.empty(n, np.float32)
    h = filters()
    for first in range(UP):
        j = np.arange(first, n, UP)
        at, phase = j * DOWN // UP, first * DOWN % UP
        acc = np.zeros(len(j), np.float32)
        for k in range(TAPS):
            acc += padded[at + k] * h[phase, k]
        out[first::UP] = acc
    return out


@lru_cache(maxsize=1)
def mel_edges() -> np.ndarray:
    """FFT bins of the bands' feet and peaks, even on the mel scale: band i rises from i to i + 1 and falls to i + 2."""
    top = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + top / 700), BANDS + 2)
    bins = np.floor((WINDOW // 2 + 1) * (700 * (10 ** (mel / 2595) - 1)) / top).astype(int)
    for i in range(1, len(bins)):
        bins[i] = max(bins[i], bins[i - 1] + 1)
    return np.minimum(bins, WINDOW // 2 + 1 + np.arange(len(bins)) - len(bins) + 1)


@lru_cache(maxsize=1)
def rise() -> np.ndarray:
    """Each bin's place between the edges around it, 0 to 1: its weight in the band that rises there."""
    e = mel_edges()
    i = np.searchsorted(e, np.arange(e[0], e[-1]), side="right") - 1
    return ((np.arange(e[0], e[-1]) - e[i]) / (e[i + 1] - e[i])).astype(np.float32)


@lru_cache(maxsize=1)
def window() -> np.ndarray:
    return np.hanning(WINDOW).astype(np.float32)


def frame_count(n: int) -> int:
    """Frames that hold all of ``n`` resampled samples, the last filled with zeros."""
    return max(0, -(-(n - WINDOW) // HOP)) + 1


def mel_frames(samples: np.ndarray, skip: int = 0) -> np.ndarray:
    """frames x BANDS log-mel energies (float32) of 8-bit samples; ``skip``: samples of context before them."""
    x = resample((samples.astype(np.float32) - np.float32(128)) / np.float32(128))[skip * UP // DOWN :]
    x = np.concatenate([x, np.zeros(WINDOW + (frame_count(len(x)) - 1) * HOP - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    spectrum = np.fft.rfft(frames * window(), axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    e, up = mel_edges(), rise()
    power = power[:, e[0] : e[-1]]
    rising, falling = (np.add.reduceat(power * w, e[:-1] - e[0], axis=1) for w in (up, 1 - up))
    bands = rising[:, :-1] + falling[:, 1:]
    return np.log(bands + np.float32(1e-6)).astype(np.float32)


def all_frames(samples: np.ndarray) -> np.ndarray:
    """``mel_frames`` in blocks of bounded size, each with the context that filter and frames need."""
    if len(samples) <= BLOCK:
        return mel_frames(samples)
    step = BLOCK // (HOP * DOWN) * HOP * DOWN
    per = step * UP // DOWN // HOP
    total = frame_count(len(samples) * UP // DOWN)
    out = []
    for k, lo in enumerate(range(0, len(samples), step)):
        left = min(total - k * per, per)
        if left > 0:
            skip = min(lo, 4 * TAPS)
            out.append(mel_frames(samples[lo - skip : lo + step + WINDOW], skip)[:left])
    return np.concatenate(out)


def segments(frames: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) frames in which the energy rose above ENTER and has not fallen below LEAVE."""
    energy = frames.mean(axis=1)
    energy = energy - energy.mean()
    state = np.where(energy > ENTER, 1, np.where(energy < LEAVE, -1, 0))
    at = np.flatnonzero(state)
    on = np.zeros(len(state), bool)
    if at.size:
        last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
        on = (last >= 0) & (state[np.maximum(last, 0)] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


#: Seconds from one frame to the next, and a frame's length.
STEP_S, FRAME_S = HOP / (RATE * UP / DOWN), WINDOW / (RATE * UP / DOWN)
SPAN = pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())])


def tensor_type() -> pa.FixedShapeTensorType:
    return pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, BANDS), dim_names=["frame", "band"])


def in_tensors(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tensors x TENSOR_FRAMES x BANDS, the last filled with zeros; frames that each holds)."""
    many = -(-len(frames) // TENSOR_FRAMES)
    full = np.zeros((many * TENSOR_FRAMES, BANDS), np.float32)
    full[: len(frames)] = frames
    return full.reshape(many, TENSOR_FRAMES, BANDS), np.minimum(TENSOR_FRAMES, len(frames) - TENSOR_FRAMES * np.arange(many))


def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, text -> doc_id, n_bytes, media, segments (time spans), spans (of the tensors), voiced, mel.

    ``media`` is the stored file; the rest is computed from its bytes as read back. ``mel`` holds a
    row's tensors one after the other as a list of ``tensor_type()``, ``spans`` and ``voiced`` (frames
    inside segments) have an entry a tensor.
    """
    media, sizes, mel, many, voiced, spans, cuts, parts = [], [], [], [], [], [], [], []
    for text in batch.column(1).to_pylist():
        payload = payload_of(text)
        sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
        media.append(to_wav(payload))
        frames = all_frames(np.frombuffer(from_wav(media[-1]), np.uint8))
        found, on = segments(frames), np.zeros(len(frames), bool)
        for a, z in found:
            on[a:z] = True
        tensors, held = in_tensors(frames)
        first = TENSOR_FRAMES * np.arange(len(held))
        mel.append(tensors)
        many.append(len(held))
        voiced.append(np.add.reduceat(on, first, dtype=np.int32))
        spans.append(np.column_stack([first * STEP_S, (first + held - 1) * STEP_S + FRAME_S]))
        cuts.append(len(found))
        parts.append(np.array([(a * STEP_S, (z - 1) * STEP_S + FRAME_S) for a, z in found]).reshape(-1, 2))
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    pairs = lambda x: pa.StructArray.from_arrays([pa.array(np.concatenate(x)[:, i]) for i in (0, 1)], fields=list(SPAN))
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(np.concatenate(mel), dim_names=["frame", "band"])
    columns = {
        "doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary()), "segments": pa.ListArray.from_arrays(ends(cuts), pairs(parts)),
        "spans": pa.ListArray.from_arrays(ends(many), pairs(spans)), "voiced": pa.ListArray.from_arrays(ends(many), pa.array(np.concatenate(voiced))), "mel": pa.ListArray.from_arrays(ends(many), tensors),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def frames_of(mel: pa.FixedShapeTensorArray, spans: pa.StructArray) -> np.ndarray:
    """The frames of a row's tensors: the time spans tell how many the last one holds."""
    all_, (begin, end) = mel.to_numpy_ndarray().reshape(-1, BANDS), (spans.field(i)[len(spans) - 1].as_py() for i in (0, 1))
    return all_[: (len(spans) - 1) * TENSOR_FRAMES + round((end - begin - FRAME_S) / STEP_S) + 1]


def feature(frames: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """frames:mean of each band:spread of each band:segments:seconds in them, first and last second (0 without)."""
    mean, spread = frames.mean(axis=0, dtype=np.float64), frames.std(axis=0, dtype=np.float64)
    held = sum(z - a for a, z in spans)
    edges = (spans[0][0], spans[-1][1]) if spans else (0.0, 0.0)
    return f"{len(frames)}:{','.join(f'{v:.3f}' for v in mean)}:{','.join(f'{v:.3f}' for v in spread)}:{len(spans)}:{held:.4f},{edges[0]:.4f},{edges[1]:.4f}"


def digested(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The digest of each row of ``encoded``: of the file as read back, and of its tensors and spans."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tensors"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    out = []
    media, parts, spans, mel = (rows.column(rows.schema.get_field_index(c)) for c in ("media", "segments", "spans", "mel"))
    for i in range(rows.num_rows):
        stored = media[i].as_py()
        back = from_wav(stored)
        found = [(x["begin_s"], x["end_s"]) for x in parts[i].as_py()]
        own = frames_of(mel[i].values, spans[i].values)
        out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(own, found), len(spans[i].values)))
    columns = [rows.column(0), rows.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[2:], strict=True))]
    return pa.RecordBatch.from_arrays(columns, names)


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """A row's digest, taken from its stored file, tensors and spans."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tensors long"
    return texts(docs).mapInArrow(lambda batches: (digested(encoded(b)) for b in chunks(batches)), schema)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored file), segments: time spans of the text's voiced parts."""
    schema = "doc_id long, n_bytes long, media binary, segments array<struct<begin_s:double,end_s:double>>"
    return texts(docs).mapInArrow(lambda batches: (encoded(b).select([0, 1, 2, 3]) for b in chunks(batches)), schema)


def tensors(docs: DataFrame) -> DataFrame:
    """doc_id, part, begin_s, end_s, voiced, mel: TENSOR_FRAMES x BANDS floats each, the last filled with zeros.

    ``mel`` is the flat storage of ``tensor_type()``; ``voiced`` counts the frames inside segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = encoded(batch)
            spans, voiced, mel = (rows.column(i) for i in (4, 5, 6))
            many = np.diff(np.asarray(spans.offsets))
            part = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            flat = mel.values.storage.flatten()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * TENSOR_FRAMES * BANDS), flat)
            columns = [rows.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array(part.astype(np.int32)), spans.values.field(0), spans.values.field(1), voiced.values, lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "begin_s", "end_s", "voiced", "mel"])

    return texts(docs).mapInArrow(run, "doc_id long, part int, begin_s double, end_s double, voiced int, mel array<float>")


def as_tensor(mel: pa.Array) -> pa.FixedShapeTensorArray:
    """The ``mel`` column of ``tensors`` as an Arrow tensor column."""
    flat = mel.flatten() if not isinstance(mel, pa.ChunkedArray) else mel.combine_chunks().flatten()
    return pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(flat, TENSOR_FRAMES * BANDS))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
