"""Vectorised word and byte helpers over Arrow string columns.

Everything here works on one Arrow batch inside a task: the text column's own
buffers are viewed as numpy arrays, so no Python string is built per word.
Words are maximal runs of bytes that a 256-entry table calls word bytes; every
byte of a multi-byte UTF-8 character is >= 0x80, so the tables below give the
same words as the equivalent regular expression over code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: UTF-8 continuation bytes are no code point of their own
CODE_POINT = np.ones(256, bool)
CODE_POINT[0x80:0xC0] = False

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: bytes hashed at a time, a bound on the temporary arrays
SPAN = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _INVERSE = powers(BASE, SPAN), powers(BASE_INVERSE, SPAN)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Power tables for a span that one huge word makes longer than SPAN."""
    return (_POWER, _INVERSE) if n <= SPAN else (powers(BASE, n), powers(BASE_INVERSE, n))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; element i covers values[i:i+k]."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = max(SPAN - k, 1)
    for a in range(0, n, step):
        b = min(a + step, n)
        v = values[a : b + k - 1].astype(np.uint64) + np.uint64(1)
        p, q = _grown(len(v))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * p[: len(v)], dtype=np.uint64)])
        out[a:b] = (total[k:] - total[: len(total) - k])[: b - a] * q[: b - a]
    return mix(out)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end]; starts ascend. Equal ranges hash equal wherever they lie."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SPAN, "right")))
        s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
        v = values[starts[a] : int(ends[a:b].max())].astype(np.uint64) + np.uint64(1)
        p, q = _grown(len(v) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * p[: len(v)], dtype=np.uint64)])
        out[a:b] = (total[e] - total[s]) * q[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        a = b
    return mix(out)


def string_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; a null has no bytes."""
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` text bytes; one longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_view(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
            yield batch.slice(a, min(b, batch.num_rows) - a)
            a = b


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in as few batches as hold about `most` text bytes each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, most):
        n = int(string_view(batch.column(column))[1][-1])
        if held and size + n > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Words:
    """The words of one batch: byte ranges, and which range of words is each row's."""

    def __init__(self, column: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = False):
        data, offsets = string_view(column)
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = table[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = offsets[1:-1][inside[offsets[1:-1]]]  # a row's first byte starts a word whatever stands before it
        first[cut] = True
        last = inside[:-1] & (~inside[1:] | first[1:])
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)


def trimmed() -> None:
    """Give freed memory back to the system: Python workers stay behind their tasks, and what they hold counts
    beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(step: Callable) -> Callable:
    """A step over a task's batches that gives its memory back at the end."""

    @functools.wraps(step)
    def called(*args, **more):
        yield from step(*args, **more)
        trimmed()

    return called


@released
def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their text compressed, for a shuffle: column `text` becomes binary `blob`, a null stays one."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in gathered(batches, "text", 4 << 20):
        blobs = pa.array([None if x is None else squeeze.compress(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())
        names = ["blob" if n == "text" else n for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays([blobs if n == "blob" else batch.column(n) for n in names], names)


def unpacked(blobs: pa.Array) -> list[bytes]:
    """The bytes of each text of a packed column; a null has none."""
    expand = zstandard.ZstdDecompressor()
    return [b"" if x is None else expand.decompress(x) for x in blobs.to_pylist()]
