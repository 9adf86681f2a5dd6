"""SHA-256 with its state in the open, for many digests at once.

A digest as hexadecimal text fills one block of SHA-256 exactly. So the state of a
hash that has taken i digests is eight words, which can be kept, copied, stored and
taken up again later, in another task. Arrays are words by row: (8, n) or (16, n).
"""

from __future__ import annotations

import math

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: the first 32 bits behind the point of the roots of primes, as the standard has them
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
#: 16 bits to the four bytes of their hexadecimal text
_TEXT = np.frombuffer(b"".join(b"%04x" % i for i in range(1 << 16)), ">u4").astype(np.uint32)


def _turned(x: np.ndarray, *by: int) -> np.ndarray:
    """Exclusive or of x turned right by each count."""
    out = (x >> np.uint32(by[0])) | (x << np.uint32(32 - by[0]))
    for r in by[1:]:
        out ^= (x >> np.uint32(r)) | (x << np.uint32(32 - r))
    return out


def _schedule(block: np.ndarray) -> list[np.ndarray]:
    w = list(block)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turned(a, 7, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turned(b, 17, 19) ^ (b >> np.uint32(10))))
    return [x + k for x, k in zip(w, ROUND, strict=True)]


def _rounds(state: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    a, b, c, d, e, f, g, h = state
    for w in words:
        one = h + _turned(e, 6, 11, 25) + (g ^ (e & (f ^ g))) + w
        two = _turned(a, 2, 13, 22) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([np.broadcast_to(x, state.shape[1:]) for x in (a, b, c, d, e, f, g, h)])


def fresh(n: int) -> np.ndarray:
    """n states that have taken nothing."""
    return np.repeat(START[:, None], n, 1)


def taken(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The states once each has also taken the hexadecimal text of a digest."""
    if not state.shape[1]:
        return state
    block = np.empty((16, digests.shape[1]), np.uint32)
    block[0::2], block[1::2] = _TEXT[digests >> np.uint32(16)], _TEXT[digests & np.uint32(0xFFFF)]
    return _rounds(state, _schedule(block))


_ENDS: dict[int, list[np.ndarray]] = {}


def finished(state: np.ndarray, count: int) -> np.ndarray:
    """The digests of states that have taken `count` digests."""
    if count not in _ENDS:
        bits = 512 * count
        end = np.zeros((16, 1), np.uint32)
        end[0], end[14], end[15] = 1 << 31, bits >> 32, bits & 0xFFFFFFFF
        _ENDS[count] = _schedule(end)
    return _rounds(state, _ENDS[count]) if state.shape[1] else state


def words(digests: list[bytes]) -> np.ndarray:
    """Digests of 32 bytes as words by row."""
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).T.astype(np.uint32)


def packed(digests: np.ndarray) -> bytes:
    """Words by row as bytes, a digest or state behind another."""
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").reshape(-1, 8).T.astype(np.uint32)


def texts(digests: np.ndarray) -> np.ndarray:
    """(n, 64) bytes of hexadecimal text."""
    pairs = np.empty((digests.shape[1], 16), np.uint32)
    pairs[:, 0::2], pairs[:, 1::2] = _TEXT[digests >> np.uint32(16)].T, _TEXT[digests & np.uint32(0xFFFF)].T
    return pairs.astype(">u4").view(np.uint8).reshape(-1, 64)
