"""A run-length index of a repetitive text, in numpy.

The Burrows-Wheeler transform of the text is cut into runs. Where a run
begins, the predecessor in suffix order and the length that both share are
sampled; for every other position they follow from the next sample, as both
move with the position inside a run. So long matches of all positions are
streamed from as many samples as the transform has runs.
"""

from __future__ import annotations

import numpy as np

#: Symbols are 0 for a separator and byte + 1; 7 of them fit a word.
BITS, PACK = 9, 7


def symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts, each followed by a separator, and where each begins."""
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    # one more byte at the end of each part holds the separator's place
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
    text[begin + sizes - 1] = 0
    return text, begin


def packed(text: np.ndarray) -> np.ndarray:
    """PACK symbols from each position on as one integer; beyond the end are separators."""
    key = np.zeros(len(text), np.int64)
    for k in range(PACK):
        key <<= BITS
        key[: len(text) - k] |= text[k:]
    return key


def suffix_array(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and each one's rank, by doubling; only suffixes that are still tied are sorted again."""
    n = len(text)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    single = new & np.append(new[1:], True)
    rows = np.flatnonzero(~single)
    depth = PACK
    while len(rows):
        at = order[rows]
        after = at + depth
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] << 32 | second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rows = rows[~(new & np.append(new[1:], True))]
        depth *= 2
    return order, rank


class RunIndex:
    """at: sampled positions, ascending; before: the suffix just before each in order; shared: symbols that both share, up to most."""

    def __init__(self, text: np.ndarray, most: int):
        n = len(text)
        key = packed(text)
        order, rank = suffix_array(text, key)
        bwt = text[order - 1]
        bwt[rank[0]] = -1  # nothing stands before the first suffix
        heads = np.ones(n, bool)
        heads[1:] = bwt[1:] != bwt[:-1]
        self.n_runs = int(heads.sum())
        at = order[heads] - 1
        self.at = np.unique(np.append(at[at >= 0], n - 1))
        row = rank[self.at]
        self.before = np.where(row > 0, order[np.maximum(row, 1) - 1], -1)
        self.shared = self._compare(text, key, most)

    def _compare(self, text: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
        n, shared = len(text), np.zeros(len(self.at), np.int64)
        k = np.flatnonzero(self.before >= 0)
        done = 0
        while len(k) and done < most:
            a, b = self.at[k] + done, self.before[k] + done
            inside = np.maximum(a, b) < n
            k, a, b = k[inside], a[inside], b[inside]
            differ = key[a] ^ key[b]
            same = differ == 0
            k_, d = k[~same], differ[~same]
            top = np.zeros(len(d), np.int64)  # symbols before the first difference
            for j in range(1, PACK):
                top[d >> (BITS * (PACK - j)) == 0] = j
            shared[k_] += top
            k = k[same]
            shared[k] += PACK
            done += PACK
        return shared

    def matches(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the length that it shares with its predecessor in order (exact below the sampled limit) and that predecessor."""
        q = np.searchsorted(self.at, positions)
        ahead = self.at[q] - positions
        before = self.before[q]
        return np.where(before >= 0, self.shared[q] + ahead, 0), before - ahead


def first_places(text: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
    """For each position the first of positions from which on the same length symbols stand; positions: ascending, all whose length symbols hold no separator."""
    if not len(positions):
        return positions
    long, before = RunIndex(text, length).matches(positions)
    up = np.arange(len(text))
    up[positions] = np.where(long >= length, before, positions)
    while True:  # to the first in order of those that share length symbols
        over = up[up[positions]]
        if (over == up[positions]).all():
            break
        up[positions] = over
    top = up[positions]
    first = np.full(len(text), len(text), np.int64)
    np.minimum.at(first, top, positions)
    return first[top]
