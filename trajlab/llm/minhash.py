"""Signatures of documents' shingle sets: MinHash bands and odd sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trajlab.llm.text import NOT_SPACE, Words, mix, released, slices, window_hashes

SHINGLE = 5
#: MinHash samples: BANDS bands of ROWS
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: parity bits of an odd sketch, as LONGS 64-bit numbers
LONGS = 8
BITS = 64 * LONGS

_RNG = np.random.default_rng(2024)
_FACTORS = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_TERMS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in a row, ascending within a text, and each text's range.
    A text of one to four words has its whole sequence as its one shingle; one without words has none."""
    w = Words(column, NOT_SPACE, lower=True)
    h, counts = w.hashes(), w.counts
    row = w.row_of_word()
    whole = row[: len(h) - SHINGLE + 1] == row[SHINGLE - 1 :] if len(h) >= SHINGLE else np.empty(0, bool)
    owner, value = row[: len(whole)][whole], window_hashes(h, SHINGLE)[whole]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        start = w.rows[:-1][short]
        total = mix(h[start])
        for k in range(1, SHINGLE - 1):
            more = counts[short] > k
            total[more] = mix(total[more] * np.uint64(0x9E3779B97F4A7C15) + h[start[more] + k])
        owner, value = np.concatenate([owner, short]), np.concatenate([value, total])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[keep], value[keep]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(value: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each non-empty set: its identity (two 64-bit sums over its elements), its BANDS band keys
    and its odd sketch."""
    start = ranges[:-1][np.diff(ranges) > 0]
    n = len(start)
    identity, bands, odd = np.zeros((n, 2), np.uint64), np.zeros((n, BANDS), np.uint64), np.zeros((n, LONGS), np.uint64)
    if not n:
        return identity, bands, odd
    identity[:, 0] = np.add.reduceat(mix(value + np.uint64(0x632BE59BD9B4E019)), start)
    identity[:, 1] = np.add.reduceat(mix(value ^ np.uint64(0xD1B54A32D192ED03)), start)
    every = np.arange(n)
    for i in range(SAMPLES):
        least = np.minimum.reduceat(value * _FACTORS[i] + _TERMS[i], start)
        band = i // ROWS
        bands[:, band] = mix(bands[:, band] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(i))
        bit = mix(least + _SALTS[i]) % np.uint64(BITS)
        odd[every, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return identity, bands, odd


def most_differing_bits(least_similarity: float, sigmas: float = 6.5) -> int:
    """Bits in which the odd sketches of two sets of at least that similarity may differ: each pair of
    samples that differ flips two parities, some of which meet again. So many standard deviations beyond
    the mean number of such pairs, one link in ten thousand million is missed."""
    d = 1 - least_similarity
    flips = 2 * (SAMPLES * d + sigmas * np.sqrt(SAMPLES * d * (1 - d)))
    return int(np.ceil(BITS * (1 - (1 - 2 / BITS) ** flips) / 2))


def similarity(differing_bits: int) -> float:
    """The similarity that the sketches of two sets differing in so many bits estimate."""
    z = min(differing_bits, BITS // 2 - 1)
    return 1 - np.log(1 - 2 * z / BITS) / np.log(1 - 2 / BITS) / (2 * SAMPLES)


@released
def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, n_shingles, a, b (identity), bands, odd of each row; nulls where the set is empty."""
    for batch in slices(batches, "text"):
        value, ranges = shingle_sets(batch.column("text"))
        sizes = np.diff(ranges)
        identity, bands, odd = signatures(value, ranges)
        full = sizes > 0
        take = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full)

        def lists(x: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().view(np.int64))).take(take)

        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(identity[:, k]).view(np.int64)).take(take) for k in (0, 1)), lists(bands), lists(odd)], ["doc_id", "text_key", "n_shingles", "a", "b", "bands", "odd"])


SIGNED = "doc_id long, text_key long, n_shingles long, a long, b long, bands array<long>, odd array<long>"
