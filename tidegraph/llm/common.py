"""Arrow and numpy helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_CLEAR: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = [""]


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Python workers outlive a stage: when another operator starts in one, what the last remembered goes.

    ``clear`` drops the owner's caches; freed memory goes back to the system.
    """
    if clear is not None:
        _CLEAR[owner] = clear
    if _OWNER[0] != owner:
        if _OWNER[0] in _CLEAR:
            _CLEAR[_OWNER[0]]()
        _POWERS.clear()
        _OWNER[0] = owner
        gc.collect()
        trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so extra or clashing columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_id, text) slices of about max_bytes of text: bounds what numpy holds at a time.

    A longer single text is a slice of its own: texts are never cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(0), batch.column(1)
        ends = raw(texts)[1][1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield ids.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop
    trim()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased (A-Z) bytes, split at space and 0x09-0x0D, over several texts at once.

    Returns the normal form (every word followed by one space; texts end to end), the start of each word
    in it, and for each text the number of words before it (length texts + 1). A word never spans texts.
    """
    low = LOWER[data]
    gap = SPACE[data]
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    begins = ~gap
    begins[1:] &= gap[:-1] | first[1:n]
    at = np.flatnonzero(begins)
    stops = ~gap
    stops[:-1] &= gap[1:] | first[1:n]
    end = np.flatnonzero(stops) + 1
    before = np.searchsorted(at, offsets)
    size = end - at
    starts = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size + 1, out=starts[1:])
    norm = np.full(starts[-1], 0x20, np.uint8)
    keep = np.ones(starts[-1], dtype=bool)
    if len(at):
        keep[starts[1:] - 1] = False
    norm[keep] = low[~gap]
    return norm, starts, before


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64; :func:`span_hash` reads spans off it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    inverse = powers(len(prefix), _INV)
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


BLOCK_BYTES = 6 << 20
BLOCK_SCHEMA = "block long, ids binary, offsets binary, body binary"


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Whole texts packed into rows of about block_bytes: doc ids, offsets and zstd-compressed bytes.

    Later stages exchange few large rows and work on them with numpy. Rows without an id are left out. The
    caller materialises the result, so that a block's number names the same texts in every stage.
    """
    import zstandard
    from pyspark import TaskContext

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, bodies, held = [], [], 0

        def block():
            nonlocal ids, bodies, held, seq
            size = np.concatenate([np.diff(o) for _, o in bodies])
            row = [pa.array([(part << 32) + seq], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate([[0], np.cumsum(size)]).tobytes()], pa.binary()), pa.array([zstandard.compress(b"".join(d.tobytes() for d, _ in bodies), 3)], pa.binary())]
            ids, bodies, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "offsets", "body"])

        for some, texts in pieces(batches, block_bytes):
            data, offsets = raw(texts)
            if held and held + len(data) > block_bytes:
                yield block()
            ids.append(some.to_numpy(zero_copy_only=False).astype(np.int64))
            bodies.append((data.copy(), offsets.copy()))
            held += len(data)
        if ids:
            yield block()

    return id_text(docs).where("doc_id is not null").mapInArrow(run, BLOCK_SCHEMA)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, offsets, bytes) of a block row."""
    import zstandard

    offsets = np.frombuffer(row["offsets"], np.int64)
    return np.frombuffer(row["ids"], np.int64), offsets, np.frombuffer(zstandard.decompress(row["body"], max(int(offsets[-1]), 1)), np.uint8)


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of equal or different length and type in one compressed binary value."""
    import pickle

    import zstandard

    return zstandard.compress(pickle.dumps([np.ascontiguousarray(c) for c in columns], protocol=5), 1)


def unpack_columns(blob: bytes) -> list[np.ndarray]:
    import pickle

    import zstandard

    return pickle.loads(zstandard.decompress(blob))
