"""A run-compressed Burrows-Wheeler index over many short strings, and what it tells about long matches.

The strings stand in one text, each closed by its own separator, so no match crosses one. The index keeps the transform
as runs and the suffix-array sample at each run's head and at the end of the run before it: ``phi`` of a sampled position is
the suffix just before it. Between samples, ``phi`` and the common length follow from the sample to the left: inside
a run both move on by one symbol.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACK = 7                    # symbols of 9 bits in a word


class RunIndex:
    """``strings``: the strings joined as bytes; ``lengths``: of each one."""

    def __init__(self, strings: bytes, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        ends = np.cumsum(lengths + 1) - 1                       # separators
        n = int(ends[-1]) + 1 if len(ends) else 0
        symbols = np.zeros(n + PACK, np.uint64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[:n][inside] = np.frombuffer(strings, np.uint8).astype(np.uint64) + np.uint64(1)
        self.n, self.starts = n, ends - lengths
        #: symbols from a position to its string's end
        self.left = (np.repeat(ends, lengths + 1) - np.arange(n)) if n else np.zeros(0, np.int64)
        words = np.zeros(n, np.uint64)
        for i in range(PACK):
            part = symbols[i:i + n].copy()
            part[self.left < i] = 0                              # nothing counts from the separator on
            words = (words << np.uint64(9)) | part
        self.words = words
        sa = self._suffixes()
        bwt = symbols[:n][sa - 1]
        head = np.ones(n, bool)
        # a separator is like no other symbol, so it is always a run of its own
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        at = np.flatnonzero(head)
        self.run_symbols, self.run_starts = bwt[at], at
        self.sampled, self.sampled_phi = sa[at], np.where(at > 0, sa[at - 1], -1)
        order = np.argsort(self.sampled)
        self.sampled, self.sampled_phi = self.sampled[order], self.sampled_phi[order]

    def _suffixes(self) -> np.ndarray:
        """Order of all suffixes by doubling. Suffixes that meet their separators at once are told apart by position."""
        n = self.n
        sa = np.argsort(self.words)
        w = self.words[sa]
        new = np.ones(n, bool)
        new[1:] = w[1:] != w[:-1]
        # equal ones in order of position: only the values are sorted
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        sa[at] = np.sort(np.cumsum(new)[at] << 32 | sa[at]) & ((1 << 32) - 1)
        new[1:] |= self.left[sa[1:]] < PACK
        places = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(new, places, 0))      # the place of the first of equal ones
        tied = ~new
        tied[:-1] |= ~new[1:]
        at, width = np.flatnonzero(tied), PACK
        sub = sa[at]
        while len(at):                                           # only what is still equal is ordered again
            after = sub + width
            key = rank[sub] * np.int64(n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            o = np.argsort(key)                                  # what stays equal is ordered in a later round
            sub, key = sub[o], key[o]
            sa[at] = sub
            fresh = np.ones(len(at), bool)
            fresh[1:] = key[1:] != key[:-1]
            rank[sub] = np.maximum.accumulate(np.where(fresh, at, 0))
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            at, sub = at[tied], sub[tied]
            width *= 2
        return sa

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at p and q have in common, up to either separator."""
        most = np.minimum(self.left[p], self.left[q])
        size = np.zeros(len(p), np.int64)
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            a, b = self.words[p[open_] + size[open_]], self.words[q[open_] + size[open_]]
            x = a ^ b
            bits = np.zeros(len(x), np.int64)                    # of the highest difference
            some = x != 0
            bits[some] = np.frexp(x[some].astype(np.float64))[1]
            # astype rounds up at most to the next power of two: correct that
            over = some & (bits > 0) & ((x >> np.maximum(bits - 1, 0).astype(np.uint64)) == 0)
            bits[over] -= 1
            same = np.where(some, (9 * PACK - bits) // 9, PACK)
            size[open_] += same
            open_ = open_[(same == PACK) & (size[open_] < most[open_])]
        return np.minimum(size, most)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position, streamed from left to right: the suffix just before its own in order, and how many symbols both share."""
        p, q = self.sampled, self.sampled_phi
        lcp = np.zeros(len(p), np.int64)
        some = q >= 0
        lcp[some] = self._common(p[some], q[some])
        held = np.zeros(self.n, bool)
        held[p] = True
        nearest = np.cumsum(held) - 1                            # the sample at a position or to its left
        gone = np.arange(self.n) - p[nearest]
        phi = np.where(q[nearest] >= 0, q[nearest] + gone, -1)
        return phi, np.maximum(lcp[nearest] - gone, 0)

    def repeated(self, length: int) -> np.ndarray:
        """Whether the ``length`` symbols from a position also start at an earlier one."""
        phi, shared = self.matching_statistics()
        long = np.flatnonzero(shared >= length)
        # positions with equal windows form chains along phi; the smallest of a chain is the first occurrence
        chained = np.zeros(self.n, bool)
        chained[long] = chained[phi[long]] = True
        first = np.flatnonzero(chained)                          # only these are looked at; they are known by their places here
        place = np.cumsum(chained) - 1
        up = np.arange(len(first))
        up[place[long]] = place[phi[long]]
        low = np.minimum(np.arange(len(first)), up)
        while True:                                              # doubling: low covers 2, 4, 8 ... links
            further = np.minimum(low, low[up])
            jump = up[up]
            if (jump == up).all() and (further == low).all():
                break
            low, up = further, jump
        # the smallest seen from a chain's far end holds for all of it
        best = np.full(len(first), len(first))
        np.minimum.at(best, up, np.arange(len(first)))
        out = np.zeros(self.n, bool)
        out[first] = best[up] < np.arange(len(first))
        return out
