"""A hash table of numpy arrays: many keys are found or entered at once."""

from __future__ import annotations

import numpy as np


class Table:
    """Numbers of distinct non-negative 63-bit keys, in the order they were entered."""

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.key, self.number = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the free place where it would."""
        mask = (1 << self.bits) - 1
        place = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.key[place]
        miss = np.flatnonzero((found != keys) & (found >= 0))
        while len(miss):
            place[miss] = (place[miss] + 1) & mask
            found = self.key[place[miss]]
            miss = miss[(found != keys[miss]) & (found >= 0)]
        return place

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where it is new."""
        place = self._place(keys)
        return np.where(self.key[place] >= 0, self.number[place], -1)

    def enter(self, keys: np.ndarray) -> None:
        """New keys, each once."""
        number = np.arange(self.used, self.used + len(keys))
        self.used += len(keys)
        if 2 * self.used > 1 << self.bits:
            old = np.flatnonzero(self.key >= 0)
            keys, number = np.append(self.key[old], keys), np.append(self.number[old], number)
            self.bits = (2 * self.used).bit_length()
            self.key, self.number = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        while len(keys):      # when two want one place, one waits for the next turn
            place = self._place(keys)
            _, one = np.unique(place, return_index=True)
            self.key[place[one]], self.number[place[one]] = keys[one], number[one]
            keys, number = np.delete(keys, one), np.delete(number, one)


class Column:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> int:
        """Where the values start."""
        at, self.used = self.used, self.used + len(values)
        if self.used > len(self.data):
            self.data = np.append(self.data, np.zeros(max(self.used - len(self.data), len(self.data)), self.data.dtype))
        self.data[at:self.used] = values
        return at
