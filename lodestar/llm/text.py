"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` in the UTF-8 text with A-Z lower-cased; it is
identified by a 64-bit hash. Everything works on slices of bounded size (one very long text is one slice).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestar.session import ship

#: Text bytes handled at once.
SLICE = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation.
MARKS = _SPACE.copy()
MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def map_arrow(df: DataFrame, fn, fields: str) -> DataFrame:
    """``mapInArrow`` whose functions may live in this package on any executor."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, fields)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


class Words(NamedTuple):
    """Words of consecutive texts; text i has the words ``of[i]:of[i + 1]``."""

    hash: np.ndarray   # uint64
    start: np.ndarray  # byte positions in ``data``
    end: np.ndarray
    of: np.ndarray
    data: np.ndarray   # lower-cased bytes
    offsets: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut to at most ``limit`` bytes of text (a longer text alone), with bytes and offsets."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            i = j


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """``space``: by byte, what separates words."""
    data = _LOWER[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data, offsets)
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)                     # a text begins here
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(h, start, end, np.searchsorted(start, offsets), data, offsets)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text (the whole sequence if it is shorter, none without words)
    and the offset of each text in them; repeats are kept."""
    count = np.diff(w.of)
    rows = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(rows, out=at[1:])
    if at[-1] == 0:
        return np.zeros(0, np.uint64), at
    doc = np.repeat(np.arange(len(rows)), rows)
    begin = np.arange(at[-1]) - at[doc] + w.of[doc]
    length = np.minimum(count, size)[doc]
    out = mix(length.astype(np.uint64))
    for k in range(size):
        inside = k < length
        out = np.where(inside, mix(out ^ w.hash[np.minimum(begin + k, len(w.hash) - 1)]) + np.uint64(k), out)
    return out, at


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
