"""Membership of many hashes in a set that fits in memory."""

from __future__ import annotations

import numpy as np

_FILTER = 1 << 22


class Lookup:
    """Position in a sorted set of hashes, by way of a small filter that nearly all absent ones fail."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.filter = np.zeros(_FILTER, bool)
        self.filter[self._slot(self.values)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x & np.uint64(_FILTER - 1)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in x, where in values) of the members."""
        at = np.flatnonzero(self.filter[self._slot(x)])
        if not len(at) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        hit = self.values[pos] == x[at]
        return at[hit], pos[hit]
