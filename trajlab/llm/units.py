"""A bounded store from text units to their token ids, kept by a Python worker from task to task."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_at_spaces(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts between single spaces, the number of each part of all texts in a row, and
    how many parts each text has (an empty text has one, a null none)."""
    lists = pc.split_pattern(column.cast(pa.large_string()), " ")
    parts = lists.flatten().dictionary_encode()
    # by way of numpy, as to_pylist takes several times as long
    return parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy(), pc.fill_null(lists.value_lengths(), 0).to_numpy()


class UnitStore:
    """Each distinct unit is encoded once while the store holds it. When the store passes its
    bounds it starts anew, which costs time and changes no result."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most_units: int = 1_000_000, most_ids: int = 8_000_000):
        """encode: distinct units to (all their ids in a row, the number of ids of each)."""
        self.encode, self.most_units, self.most_ids = encode, most_units, most_ids
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.start = np.zeros((1 << 16) + 1, np.int64)
        self.n = 0

    def _room(self, units: int, ids: int) -> None:
        if self.n + units + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(units + 1, len(self.start)), np.int64)])
        if self.start[self.n] + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(ids, len(self.flat)), np.int32)])

    def ids(self, units: list[str], at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, and how many ids each unit has; with `at`, those of units[at],
        where units are distinct."""
        if self.n > self.most_units or self.start[self.n] > self.most_ids:
            self.clear()
        found = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        absent = np.flatnonzero(found < 0)
        if len(absent):
            new = [units[i] for i in absent.tolist()]
            if at is None:
                new = list(dict.fromkeys(new))
            flat, counts = self.encode(new)
            self._room(len(new), len(flat))
            end = self.start[self.n]
            self.flat[end : end + len(flat)] = flat
            self.start[self.n + 1 : self.n + 1 + len(new)] = end + np.cumsum(counts)
            self.index.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            found[absent] = np.arange(self.n, self.n + len(new)) if len(new) == len(absent) else [self.index[units[i]] for i in absent.tolist()]
            self.n += len(new)
        if at is not None:
            found = found[at]
        counts = self.start[found + 1] - self.start[found]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[found] - ends + counts, counts) + np.arange(total)], counts
