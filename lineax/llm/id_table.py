"""A table from 64-bit segment names to token ids, bounded in bytes: flat arrays, no object per segment."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

U = np.uint64


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start[i], start[i] + n[i])``."""
    total = int(n.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(start - (np.cumsum(n) - n), n)


class IdTable:
    """Known segments in order of their names; ``most`` bounds its bytes.

    Results never depend on what is known: a segment that is not is encoded.
    When the table outgrows ``most``, only the last call's segments stay, and
    none when these alone are larger.
    """

    def __init__(self, most: int = 16 << 20, step: int = 20_000):
        self.most, self.step = most, step
        self._put(np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.int32))

    def _put(self, names: np.ndarray, n: np.ndarray, good: np.ndarray, ids: np.ndarray) -> None:
        self.names, self.n, self.good, self.ids = names, n, good, ids
        self.off = np.cumsum(n, dtype=np.int64) - n

    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.names, self.n, self.good, self.ids, self.off))

    def _at(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.names, names)
        hit = at < len(self.names)
        hit[hit] = self.names[at[hit]] == names[hit]
        return at, hit

    def lookup(self, names: np.ndarray, encode: Callable[[np.ndarray], tuple[list[list[int]], list[bool] | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all segments, their numbers, flags) for ascending distinct ``names``; ``encode`` gets positions in ``names`` and gives ids and flags."""
        _, hit = self._at(names)
        new = np.flatnonzero(~hit)
        if len(new):
            lists_n, flags, flat = [], [], []
            for a in range(0, len(new), self.step):
                part = new[a: a + self.step]
                ids, good = encode(part)
                lists_n.append(np.fromiter(map(len, ids), np.int32, len(ids)))
                flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lists_n[-1].sum())))
                flags.append(np.ones(len(ids), bool) if good is None else np.array(good, bool))
            self._merge(names[new], np.concatenate(lists_n), np.concatenate(flags), np.concatenate(flat))
        at, _ = self._at(names)
        n = self.n[at]
        ids, good = self.ids[spread(self.off[at], n)], self.good[at]
        if self.nbytes() > self.most:
            self._put(names.copy(), n, good, ids)
            if self.nbytes() > self.most:
                self._put(names[:0].copy(), n[:0], good[:0], ids[:0])
        return ids, n.astype(np.int64), good

    def _merge(self, names: np.ndarray, n: np.ndarray, good: np.ndarray, ids: np.ndarray) -> None:
        every = np.concatenate([self.names, names])
        order = np.argsort(every, kind="stable")
        lengths = np.concatenate([self.n, n])
        off = np.cumsum(lengths, dtype=np.int64) - lengths
        flat = np.concatenate([self.ids, ids])
        self._put(every[order], lengths[order], np.concatenate([self.good, good])[order], flat[spread(off[order], lengths[order])])
