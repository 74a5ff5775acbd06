"""A grouping genetic algorithm for bin packing: chromosomes are lists of bins, and crossover hands on whole bins."""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Sequence

Bins = list[list[int]]


class Packing:
    """Items of ``lengths`` (none above ``capacity``) and the moves on their packings."""

    def __init__(self, lengths: Sequence[int], capacity: int, rng: random.Random):
        self.lengths, self.capacity, self.rng = list(lengths), capacity, rng
        self.least = max(-(-sum(self.lengths) // capacity), sum(2 * x > capacity for x in self.lengths))

    def free(self, group: list[int]) -> int:
        lengths = self.lengths
        return self.capacity - sum([lengths[i] for i in group])

    def score(self, bins: Bins) -> tuple[int, int]:
        """Fewer bins first, then fuller ones; less is better."""
        return len(bins), -sum([(self.capacity - self.free(g)) ** 2 for g in bins])

    def best_fit(self, bins: Bins, items: list[int]) -> Bins:
        """Put ``items`` in turn into the bin they leave least space in, or into a new one."""
        shift = (len(bins) + len(items)).bit_length()
        low = (1 << shift) - 1
        spots = sorted([f << shift | b for b, g in enumerate(bins) if (f := self.free(g))])
        lengths = self.lengths
        for i in items:
            size = lengths[i]
            at = bisect_left(spots, size << shift)
            if at == len(spots):
                left, b = self.capacity - size, len(bins)
                bins.append([i])
            else:
                spot = spots.pop(at)
                left, b = (spot >> shift) - size, spot & low
                bins[b].append(i)
            if left:
                insort(spots, left << shift | b)
        return bins

    def seeded(self, noise: float) -> Bins:
        """Best fit by decreasing length, each length blurred by up to ``noise`` of itself."""
        blurred = [x * (1 + noise * self.rng.random()) for x in self.lengths]
        return self.best_fit([], sorted(range(len(blurred)), key=lambda i: -blurred[i]))

    def cross(self, one: Bins, two: Bins, well_filled: float) -> Bins:
        """A child of ``one`` with whole well-filled bins of ``two``: bins that share a document with these go, as does the emptiest; what they held else is placed by best fit."""
        limit = self.capacity * (1 - well_filled)
        share = self.rng.uniform(0.2, 0.8)
        child = [list(g) for g in two if self.free(g) <= limit and self.rng.random() < share]
        taken = bytearray(len(self.lengths))
        for g in child:
            for i in g:
                taken[i] = 1
        displaced: list[int] = []
        emptiest = max(range(len(one)), key=lambda b: self.free(one[b]))
        for b, g in enumerate(one):
            if b == emptiest or any([taken[i] for i in g]):
                displaced += [i for i in g if not taken[i]]
            else:
                child.append(list(g))
        displaced.sort(key=lambda i: -self.lengths[i])
        return self.best_fit(child, displaced)

    def evolve(self, population: list[Bins], size: int, generations: int, well_filled: float = 0.98) -> list[Bins]:
        """``population`` filled up to ``size`` and bred for ``generations``, best first; stops at a packing with the least possible number of bins."""
        if not self.lengths:
            return [[]]
        pool: list[tuple[tuple[int, int], Bins]] = []

        def add(bins: Bins) -> bool:
            score = self.score(bins)
            if all(score != known for known, _ in pool):  # else the like of it is there
                insort(pool, (score, bins), key=lambda x: x[0])
                del pool[size:]
            return pool[0][0][0] == self.least

        done = any([add(p) for p in population])
        for n in range(size - len(pool)):
            done = done or add(self.seeded(0.25 if n or population else 0.0))
        for _ in range(generations):
            if done or len(pool) < 2:
                break
            one, two = self.rng.sample(range(len(pool)), 2)
            done = add(self.cross(pool[one][1], pool[two][1], well_filled))
        return [p for _, p in pool]


def labels(bins: Bins, n: int) -> list[int]:
    """The number of each item's bin."""
    out = [0] * n
    for b, g in enumerate(bins):
        for i in g:
            out[i] = b
    return out


def groups(label: Sequence[int]) -> Bins:
    """The bins that ``labels`` came from, in order of their first item."""
    found: dict[int, list[int]] = {}
    for i, b in enumerate(label):
        found.setdefault(b, []).append(i)
    return list(found.values())
