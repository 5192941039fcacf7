"""A packing plan for a histogram of lengths: patterns and how often each is filled.

The plan is made on the driver from at most ``capacity`` counts, whatever the number
of documents. Patterns of a few documents are enumerated over coarse lengths, and a
non-negative least-squares fit says how often to repeat each so that together they use
up the histogram. The rounded counts are filled with exact lengths: a part by any length of its coarse
length, the last one by what just fills the room, or else by the longest that fits. What is left of the histogram
is fitted again, a few times. The residuals, and the room that fills left, are packed best-fit decreasing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations_with_replacement

import numpy as np

Pattern = tuple[tuple[int, ...], int]

#: Coarse lengths, and the most documents in a fitted pattern.
UNITS = 32
MOST_PARTS = 4
#: The most room that a fitted pattern may leave for residuals.
MOST_SLACK = 16
#: How often the rest of the histogram is fitted again.
FITS = 8
#: A plan with most from patterns is taken unless one of exact fills needs fewer sequences by more than this share.
TOLERANCE = 0.002


def patterns(units: int = UNITS, parts: int = MOST_PARTS) -> list[tuple[int, ...]]:
    """Multisets of at most ``parts`` coarse lengths (1..units) whose sum is ``units``, longest first."""
    found = [(units,)]
    for k in range(2, parts + 1):
        for head in combinations_with_replacement(range(1, units), k - 1):
            last = units - sum(head)
            if last >= head[-1]:
                found.append((*head, last)[::-1])
    return found


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets: columns enter by steepest descent and leave at zero."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(float(np.abs(a.T @ b).max(initial=0)), 1.0)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if active.all() or slope.max() <= 1e-9 * scale:
            break
        active[int(slope.argmax())] = True
        while True:
            index = np.flatnonzero(active)
            fit = np.linalg.lstsq(a[:, index], b, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[index] = fit
                break
            falling = fit <= 0
            old = x[index]
            step = (old[falling] / np.maximum(old[falling] - fit[falling], 1e-300)).min()
            x[index] = old + step * (fit - old)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


class _Stock:
    """How many documents of each length are left, with the lengths in order."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {k: n for k, n in histogram.items() if n > 0}
        self.lengths = sorted(self.left)

    def most(self, limit: int, least: int = 0) -> int:
        """The longest length in least..limit; 0 if there is none."""
        i = bisect_left(self.lengths, limit + 1)
        return self.lengths[i - 1] if i and self.lengths[i - 1] >= max(least, 1) else 0

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_left(self.lengths, length))


def filled(stock: _Stock, pattern: tuple[int, ...], capacity: int, width: float, most_slack: int = MOST_SLACK) -> tuple[int, ...] | None:
    """Lengths in stock for the parts of a pattern, with the least room left; None where it would be more than ``most_slack``."""
    chosen: list[int] = []
    room = capacity
    used: dict[int, int] = {}

    def longest(limit: int, least: int) -> int:
        while limit >= least and (found := stock.most(limit, least)):
            if stock.left[found] > used.get(found, 0):
                return found
            limit = found - 1
        return 0

    for k, part in enumerate(pattern):
        low, high = max(1, int((part - 0.5) * width)), int((part + 0.5) * width)
        if k == len(pattern) - 1:
            last = longest(room, max(1, room - most_slack))
            if not last:
                return None
            return (*chosen, last)
        if k == len(pattern) - 2:
            # This part and the last one together: the first pair that fills the room, else the fullest.
            best, length = (0, 0), longest(min(room - 1, high), low)
            while length:
                used[length] = used.get(length, 0) + 1
                last = longest(room - length, max(1, room - length - most_slack))
                used[length] -= 1
                if last and length + last > sum(best):
                    best = (length, last)
                    if length + last == room:
                        break
                length = longest(length - 1, low)
            return (*chosen, *best) if best[0] else None
        length = longest(min(room - 1, high), low)
        if not length:
            return None
        chosen.append(length)
        used[length] = used.get(length, 0) + 1
        room -= length
    return None


def fitted(stock: _Stock, capacity: int, units: int, most_slack: int = MOST_SLACK) -> list[Pattern]:
    """Fills the rounded least-squares patterns from the stock."""
    width = capacity / units
    coarse = np.zeros(units + 1)
    for length, n in stock.left.items():
        coarse[min(units, max(1, round(length / width)))] += n
    all_patterns = patterns(units)
    matrix = np.zeros((units + 1, len(all_patterns)))
    for j, p in enumerate(all_patterns):
        for part in p:
            matrix[part, j] += 1
    repeats = np.floor(nonnegative_least_squares(matrix, coarse) + 0.5).astype(int)
    out: list[Pattern] = []
    for j in np.argsort([-max(p) for p in all_patterns], kind="stable"):
        todo = int(repeats[j])
        while todo > 0 and (chosen := filled(stock, all_patterns[j], capacity, width, most_slack)):
            times = min([todo, *(stock.left[x] // chosen.count(x) for x in set(chosen))])
            for x in set(chosen):
                stock.take(x, times * chosen.count(x))
            out.append((chosen, times))
            todo -= times
    return out


def fitted_again(stock: _Stock, capacity: int, units: int, fits: int = FITS, most_slack: int = MOST_SLACK) -> list[Pattern]:
    """Fits what is left of the histogram until nothing more is filled, ``fits`` times at most."""
    out: list[Pattern] = []
    for _ in range(fits):
        if not (more := fitted(stock, capacity, units, most_slack)):
            break
        out += more
    return out


def best_fit(stock: _Stock, capacity: int, open_patterns: list[Pattern]) -> list[Pattern]:
    """Packs the rest: longest first, each into the fullest sequence that still has room, else a new one."""
    groups: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(p: tuple[int, ...], n: int) -> None:
        room = capacity - sum(p)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((p, n))

    for p, n in open_patterns:
        put(p, n)
    while stock.lengths:
        length = stock.lengths[-1]
        n = stock.left[length]
        stock.take(length, n)
        while n:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                p, m = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
                # As many of this length as fit go into each of these sequences.
                each = min(room // length, n)
                k = min(m, n // each)
                put(p + (length,) * each, k)
                if m > k:
                    put(p, m - k)
                n -= each * k
            else:
                each = min(capacity // length, n)
                put((length,) * each, n // each)
                n -= each * (n // each)
    return [x for g in groups.values() for x in g]


def plan(histogram: dict[int, int], capacity: int, units: int = UNITS) -> list[Pattern]:
    """(lengths in one sequence, number of such sequences) for the whole histogram.

    Patterns with a little room need small residuals to fill it. Where a histogram has none, and exact fills, or none at
    all, would need fewer sequences, these are taken.
    """
    plans = []
    for fits, most_slack in ((FITS, MOST_SLACK), (1, 0), (0, 0)):
        stock = _Stock({k: n for k, n in histogram.items() if k < capacity})
        plans.append(best_fit(stock, capacity, fitted_again(stock, capacity, units, fits, most_slack)))
    sizes = [sum(n for _, n in p) for p in plans]
    packed = next(p for p, n in zip(plans, sizes, strict=True) if n <= (1 + TOLERANCE) * min(sizes))
    full = histogram.get(capacity, 0)
    return ([((capacity,), full)] if full else []) + packed
