"""Equal blocks of two sequences: the longest first, then what lies before and behind it.

A block is the longest equal run; of equally long ones the first in ``a``, then the first in ``b``.
Runs are told apart by ranks: the ranks of all runs of 2^p tokens come from those of 2^(p-1) (prefix
doubling, as for a suffix array), once for the pair, and a run of any length is known by the ranks of
its first and its last 2^p tokens.  So whether two spans share a run of a length is one comparison of
sorted keys, and the longest is found by halving.

All blocks of one length along a span are taken in one sweep: behind a longest block nothing longer
is left, and before it nothing as long.  Each span that remains is searched for shorter runs only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Runs of two spans up to which they are compared as sets.
SHORT = 3_000


class Runs:
    """Ranks of the runs of 1, 2, 4, ... tokens of two sequences."""

    def __init__(self, a: Sequence, b: Sequence) -> None:
        known: dict = {}
        first = [np.array([known.setdefault(x, len(known)) for x in side], np.int64) for side in (a, b)]
        self.levels = [first]
        size = 1
        while size * 2 <= min(len(a), len(b)):
            pairs = [(x[:-size] << 32) | x[size:] for x in self.levels[-1]]
            _, ranks = np.unique(np.concatenate(pairs), return_inverse=True)
            self.levels.append([ranks[: len(pairs[0])], ranks[len(pairs[0]) :]])
            size *= 2

    def keys(self, side: int, low: int, high: int, length: int) -> np.ndarray:
        """A key of each run of ``length`` tokens within [low, high) of a side."""
        p = length.bit_length() - 1
        ranks, n = self.levels[p][side], max(0, high - low - length + 1)
        step = length - (1 << p)
        return (ranks[low : low + n] << 32) | ranks[low + step : low + step + n]

    def shared(self, span: tuple[int, int, int, int], length: int) -> bool:
        alo, ahi, blo, bhi = span
        x, y = self.keys(0, alo, ahi, length), self.keys(1, blo, bhi, length)
        if len(x) + len(y) < SHORT:  # the rule between blocks, where numpy's calls cost more than the work
            return not set(x.tolist()).isdisjoint(y.tolist())
        return bool(len(x)) and bool(len(y)) and bool(np.isin(x, y).any())

    def longest(self, span: tuple[int, int, int, int], most: int, least: int = 1) -> int:
        """The length of the longest run that both sides of a span share, at most ``most``; less than ``least``: 0."""
        low, high = 0, min(most, span[1] - span[0], span[3] - span[2])
        if high < least or not self.shared(span, least):
            return 0
        low, step = least, 1
        while low < high:  # short runs are the rule: lengths are tried from below, doubling, then halved
            at = min(low + step, high)
            if self.shared(span, at):
                low, step = at, step * 2
            else:
                high, step = at - 1, max(1, (at - 1 - low + 1) // 2)
        return low

    def sweep(self, span: tuple[int, int, int, int], length: int) -> list[tuple[int, int]]:
        """(place in a, place in b) of the blocks of ``length``: the first in ``a``, then in ``b``, then the same behind it."""
        alo, ahi, blo, bhi = span
        x, y = self.keys(0, alo, ahi, length), self.keys(1, blo, bhi, length)
        order = np.argsort(y, kind="stable")
        sorted_y = y[order]
        left, right = np.searchsorted(sorted_y, x, "left"), np.searchsorted(sorted_y, x, "right")
        out, i, j = [], 0, 0
        for at in np.flatnonzero(left < right).tolist():
            if at < i:
                continue
            places = order[left[at] : right[at]]
            k = int(np.searchsorted(places, j))
            if k < len(places):
                out.append((alo + at, blo + int(places[k])))
                i, j = at + length, int(places[k]) + length
        return out


def matching_blocks(a: Sequence, b: Sequence, least: int = 1) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of all blocks of ``least`` or more in order; blocks that touch in both are one."""
    runs = Runs(a, b)
    found: list[tuple[int, int, int]] = []
    todo = [((0, len(a), 0, len(b)), min(len(a), len(b)))]
    while todo:
        span, most = todo.pop()
        length = runs.longest(span, most, least) if most else 0
        if not length:
            continue
        i, ahi, j, bhi = span
        for x, y in runs.sweep(span, length):
            found.append((x, y, length))
            todo.append(((i, x, j, y), length - 1))
            i, j = x + length, y + length
        todo.append(((i, ahi, j, bhi), length - 1))
    out: list[tuple[int, int, int]] = []
    for i, j, k in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out
