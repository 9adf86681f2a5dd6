"""Suffix arrays over integer symbols, by prefix doubling in numpy. Symbol 0 ends a string."""

from __future__ import annotations

import numpy as np

from trajlab.llm.text import BASE, BASE_INVERSE, mix, powers

#: two ranks and a position share one 63-bit key
BITS = 21
MOST = (1 << BITS) - 1


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions of non-zero symbols in the order of the suffixes that start there.

    Suffixes are told apart by their first `depth` symbols at least; those alike
    stay in text order. Fewer than 2**21 symbols sort by packed keys, more of them column by column.
    """
    n = len(symbols)
    width = max(1, int(symbols.max(initial=0)).bit_length())
    k = min(depth, 63 // width)
    pos = np.flatnonzero(symbols)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(k, np.int64)])
    key, live = np.zeros(len(pos), np.int64), np.ones(len(pos), bool)
    for i in range(k):
        symbol = s[pos + i]
        live &= symbol > 0  # a symbol behind a terminator says nothing about the suffix before it
        key = (key << width) | np.where(live, symbol, 0)
    order = np.argsort(key, kind="stable")
    pos, key = pos[order], key[order]
    rank = np.zeros(n + 1, np.int64)
    stops = np.append(np.flatnonzero(symbols == 0), n)
    left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    fresh = np.ones(len(pos), bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
    rank[pos] = group + 1
    while k < depth:
        tied = np.zeros(len(pos), bool)
        tied[1:] = ~fresh[1:]
        tied[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(tied & (left[pos] >= k))  # suffixes that ended alike stay in text order
        if not len(slots):
            break
        p = pos[slots]
        after = rank[np.minimum(p + k, n)]
        if not after.any():
            break
        # slots ascend by group, so the sorted members fill the same slots; the index keeps ties in order
        new = np.ones(len(p), bool)
        if n <= MOST:
            packed = np.sort((group[slots] << 2 * BITS) | (after << BITS) | np.arange(len(p)))
            q = p[packed & MOST]
            head = packed >> BITS
            new[1:] = head[1:] != head[:-1]
        else:
            order = np.lexsort((after, group[slots]))
            q, one, two = p[order], group[slots][order], after[order]
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        pos[slots] = q
        fresh[slots] = new
        group[slots] = np.maximum.accumulate(np.where(new, slots, 0))
        rank[q] = group[slots] + 1
        k *= 2
    return pos


def bounds(symbols: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, offset: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Narrow each [lo, hi) of the suffix array, all alike before `offset`, to the suffixes
    with symbol wanted[j] at it: two binary searches a query, for all queries at once."""

    def first(target: np.ndarray) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) // 2
            less = symbols[np.minimum(array[mid] + offset, len(symbols) - 1)] < target[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]

    return first(wanted), first(wanted + 1)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept for the next symbols."""
    if len(_POWERS[0]) < n:
        _POWERS[:] = powers(BASE, n), powers(BASE_INVERSE, n)
    return _POWERS


class RangeHashes:
    """Prefix sums that tell the hash of any range of symbols. A terminator is like no other symbol, nor like
    one of other symbols with another salt."""

    def __init__(self, symbols: np.ndarray, salt: int):
        self.size = len(symbols)
        value = mix(symbols.astype(np.uint64))
        ends = np.flatnonzero(symbols == 0)
        value[ends] = mix(ends.astype(np.uint64) + np.uint64(salt << 40))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _tables(len(symbols) + 1)[0][: len(symbols)], dtype=np.uint64)])

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        return (self.total[start + size] - self.total[start]) * _tables(self.size + 1)[1][start]

    def common(self, a: np.ndarray, other: RangeHashes, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the longest common prefix, up to most, at places a of these symbols and b of others:
        in halving steps, by 64-bit hashes."""
        out = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(most).bit_length() - 1)
        while step:
            room = np.flatnonzero((a + out + step <= self.size) & (b + out + step <= other.size))
            same = self.of((a + out)[room], step) == other.of((b + out)[room], step)
            out[room[same]] += step
            step //= 2
        return out


def common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the longest common prefix, up to `most`, of the suffixes at a and b, pair by pair.
    symbols end with a terminator, which matches nothing."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    end = len(symbols) - 1
    for _ in range(most):
        x, y = symbols[np.minimum(a[open_] + out[open_], end)], symbols[np.minimum(b[open_] + out[open_], end)]
        open_ = open_[(x == y) & (x != 0)]
        if not len(open_):
            break
        out[open_] += 1
    return out


def common_bytes(data: np.ndarray, ends_at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for bytes, eight at a time; ends_at gives the end of the string that each position is in."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    room = np.minimum(ends_at[a] - a, ends_at[b] - b)
    out = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(room > 0)
    while len(open_):
        differ = eights[a[open_] + out[open_]] ^ eights[b[open_] + out[open_]]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[open_] += same
        open_ = open_[(same == 8) & (out[open_] < room[open_])]
    return np.minimum(out, room)
