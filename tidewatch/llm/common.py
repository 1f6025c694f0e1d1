"""Helpers shared by the corpus operators: shared storage, batch sizing, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import materialise, shared_dir  # noqa: F401

#: Text bytes that one vectorised step works on; bounds the temporaries of a Python worker.
CHUNK_BYTES = 1 << 20
#: Bytes that a worker's learned entries (words and their ids) may hold before it starts anew, about; a model may hold two such tables.
LEARNED_BYTES = 96 << 20
#: Of an entry, beside its characters: two objects' frames and a place in the table.
ENTRY_BYTES = 150
#: Stands for a null id inside joins and groupings.
NULL_ID = -(2**63)


class Learned:
    """What an operator's model has looked up so far, by key, within ``LEARNED_BYTES``."""

    def __init__(self) -> None:
        self.known: dict[str, object] = {}
        self.bytes = 0

    def forget(self) -> None:
        self.known.clear()
        self.bytes = 0

    def room(self) -> None:
        """Start anew where the entries have outgrown their bytes; call before a chunk is learned."""
        if self.bytes > LEARNED_BYTES:
            self.forget()

    def keep(self, keys: list[str], values: list[object], value_bytes: int = 0) -> None:
        """Add entries; ``value_bytes``: what the values hold beyond an object's frame."""
        self.known.update(zip(keys, values, strict=True))
        self.bytes += ENTRY_BYTES * len(keys) + 2 * sum(map(len, keys)) + value_bytes


_held: dict[tuple, object] = {}


def release() -> None:
    """Give freed memory back to the machine: an idle worker keeps what its allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def held(key: tuple, make: Callable[[], object]) -> Iterator[object]:
    """The model ``key`` of this worker while one iterator runs.

    A worker holds one model, with what it has learned, within ``LEARNED_BYTES`` each: another
    operator's goes before this one is made. What allocators hold goes when the iterator ends.
    """
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    model = _held[key]
    try:
        yield model
    finally:
        release()


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def chunks(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
        ends = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        lo = 0
        while lo < n:
            hi = int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1
            hi = min(n, max(hi, lo + 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets from 0; null rows are empty."""
    n = len(col)
    if col.null_count:
        col = col.fill_null("")
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over unsigned arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are; ``name`` may be a path of its own."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
