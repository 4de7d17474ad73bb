"""Byte-level kernels that the text operators share.

They work on whole Arrow batches: the UTF-8 bytes of many documents are hashed by one
prefix sum, so the cost is a few nanoseconds a byte and no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from bitloom.session import ship

#: Bytes of text that one kernel call handles (a longer document is handled alone).
SLICE_BYTES = 1 << 18
#: Records in an Arrow batch; a batch of the longest documents still fits a Python worker.
BATCH_RECORDS = 1000

_U = np.uint64
_M = 0x9E3779B97F4A7C15
_INV = pow(_M, -1, 1 << 64)


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for documents of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_RECORDS))
    return ship(spark)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different seeds give independent orders of the same values."""
    x = x + _U((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(256, dtype=_U), 7)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES + 2, 1 << int(n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up = np.full(size, _M, _U)
        down = np.full(size, _INV, _U)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def byte_classes(separators: bytes, fold_ascii: bool = True, only: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tables for words(): each byte's 64-bit value (A-Z as a-z), and whether it is in a word."""
    value = _BYTES.copy()
    if fold_ascii:
        value[65:91] = value[97:123]
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    if only is not None:
        inside[:] = False
        inside[list(only)] = True
    return value, inside


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about size bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, value: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word, and for each document the index of its first word (one more at the end)."""
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    b = data[base : base + n]
    off = offsets - base
    flag = np.empty(n + 2, np.int8)
    flag[0] = flag[-1] = 0
    flag[1:-1] = inside[b]
    # A word never runs over the border of two documents.
    step = np.diff(flag)
    starts, ends = step == 1, step == -1
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[(flag[cut] == 1) & (flag[cut + 1] == 1)]
    starts[both] = True
    ends[both] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _powers(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(value[b] * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
    return h, s, e, np.searchsorted(s, off)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, and where each document's begin.

    A document with fewer than k words, but one at least, has one shingle of all its words.
    """
    n_words = np.diff(first)
    parts = [_U((_M * (2 * i + 1) * (i + 3)) & (2**64 - 1) | 1) for i in range(k)]
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(n_words.dtype))
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(begin[-1]), _U)
    long = n_words >= k
    if long.any():
        whole = np.zeros(max(len(h) - k + 1, 0), _U)
        for i in range(k):
            whole += h[i : len(h) - k + 1 + i] * parts[i]
        valid = np.ones(len(whole), bool)
        for i in range(1, k):
            x = first[1:-1] - i
            valid[x[(x >= 0) & (x < len(whole))]] = False
        picked = mix(whole[valid])
        to = np.repeat(long, counts)
        out[to] = picked
    for d in np.flatnonzero(~long & (n_words > 0)):
        w = h[first[d] : first[d + 1]]
        with np.errstate(over="ignore"):
            out[begin[d]] = mix(np.array([sum(int(x) * int(p) for x, p in zip(w, parts)) & (2**64 - 1)], _U) + _U(len(w)), 3)[0]
    return out, begin
