"""A run-length Burrows-Wheeler index over many short strings, searched for all of them in step.

The transform is kept as runs of equal symbols; each run keeps the text position of its last row (sampled run ends).
Backward search follows an interval of rows and the text position of its last row, which by the toehold lemma is
either one less than before or found in the sample of a run end. That position names the interval: two strings of the
same length have it in common exactly if they are equal.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array of strings laid end to end; ``left`` counts symbols up to the end mark (symbol 0) that closes each.

    Ranks of prefixes double in length until none grows, among suffixes that are not told apart yet; equal suffixes stand
    in the order of their strings.
    """
    n = len(symbols)
    most = int(left.max()) + 1
    width = max(1, int(symbols.max()).bit_length())
    first = max(1, 63 // width)
    key = np.zeros(n, np.int64)
    for k in range(first):
        key <<= width
        if k < n:
            key[: n - k] |= np.where(left[: n - k] >= k, symbols[k:], 0)
    length, bits = first, n.bit_length()
    order = np.argsort(key, kind="stable")
    place, rank = np.arange(n), np.empty(n, np.int64)
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    while True:
        rank[order[place]] = np.maximum.accumulate(np.where(new, place, 0)) + 1
        place = place[~(new & np.append(new[1:], True))]
        if length >= most or not len(place):
            return order
        at = order[place]
        key = rank[at] << bits
        key += np.where(left[at] >= length, rank[np.minimum(at + length, n - 1)], 0)
        if 3 * bits < 64:
            key <<= bits
            key |= at
            key.sort()  # ties by place, and no order to look up
            order[place] = key & ((1 << bits) - 1)
            key >>= bits
        else:
            by = np.argsort(key, kind="stable")  # equal ones stand by place since the first sort
            key = key[by]
            order[place] = at[by]
        new = np.append(True, key[1:] != key[:-1])
        length *= 2


class RunIndex:
    """The index of ``symbols``: strings over positive symbols, each closed by symbol 0."""

    def __init__(self, symbols: np.ndarray, left: np.ndarray):
        order = suffix_order(symbols, left)
        n = len(symbols)
        before = symbols[order - 1]  # position 0 is preceded by the last end mark
        starts = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1])
        lengths = np.diff(np.concatenate([starts, [n]]))
        heads = before[starts]
        by_symbol = np.argsort(heads.astype(np.uint16) if heads.max() < 1 << 16 else heads, kind="stable")
        self.n = n
        self.heads, self.starts, self.lengths = heads[by_symbol], starts[by_symbol], lengths[by_symbol]
        self.ends = order[self.starts + self.lengths - 1]
        self.keys = self.heads * (n + 1) + self.starts
        total = np.cumsum(self.lengths) - self.lengths
        opens = np.maximum.accumulate(np.where(np.append(True, self.heads[1:] != self.heads[:-1]), np.arange(len(total)), 0))
        self.upto = total - total[opens]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.last = order[self.less[1:] - 1]  # text position of the last row of each symbol's rows

    def open(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First row, row after the last, and text position of the last row of all suffixes that begin with ``symbol``."""
        return self.less[symbol], self.less[symbol + 1], self.last[symbol]

    def _rank(self, symbol: np.ndarray, row: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` stands above ``row``, before which ``upto`` runs begin, and its last run there (which must
        exist where it counts)."""
        run = np.maximum(upto - 1, 0)
        there = self.heads[run] == symbol
        return np.where(there, self.upto[run] + np.minimum(row - self.starts[run], self.lengths[run]), 0), run

    def extend(self, symbol: np.ndarray, top: np.ndarray, end: np.ndarray, toe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Put ``symbol`` in front of each match; the longer match must occur."""
        base = symbol * (self.n + 1)
        begun = np.searchsorted(self.keys, base + top, "left")
        base += end
        more = np.flatnonzero(self.keys[np.minimum(begun, len(self.keys) - 1)] < base)  # mostly few: else no run begins in between
        above, _ = self._rank(symbol, top, begun)
        begun[more] = np.searchsorted(self.keys, base[more], "left")
        upto, run = self._rank(symbol, end, begun)
        inside = self.starts[run] + self.lengths[run] >= end
        return self.less[symbol] + above, self.less[symbol] + upto, np.where(inside, toe, self.ends[run]) - 1

    def matching_statistics(self, first: np.ndarray, patterns: list[np.ndarray], steps: int) -> np.ndarray:
        """The name of the match after each of ``steps`` symbols of every pattern, -1 beyond its end.

        Pattern i grows to the left of symbol ``first[i]``.
        """
        lengths = np.array([len(p) for p in patterns])
        named = np.full((len(patterns), steps + 1), -1, np.int64)
        lane = np.argsort(-lengths, kind="stable")
        grid = np.zeros((len(patterns), steps), np.int64)
        for i, p in enumerate(patterns):
            grid[i, : min(len(p), steps)] = p[:steps]
        top, end, toe = self.open(first[lane])
        named[lane, 0] = toe
        for k in range(steps):
            live = np.searchsorted(-lengths[lane], -k, "left")  # lanes longer than k
            if not live:
                break
            lane, top, end, toe = lane[:live], top[:live], end[:live], toe[:live]
            top, end, toe = self.extend(grid[lane, k], top, end, toe)
            named[lane, k + 1] = toe
        return named


def first_windows(group: np.ndarray, contexts: list[bytes], offsets: np.ndarray, window: int) -> list[np.ndarray]:
    """For each context, whether the window at each of its places occurs in an earlier context of its group.

    Contexts of a group share the text that begins at their offset, and all of a context's windows reach over it, so
    windows are equal exactly if they begin equally far before it and both sides of it agree.
    """
    groups, g = np.unique(group, return_inverse=True)
    left = [np.frombuffer(c[:o], np.uint8)[::-1].astype(np.int64) + 1 for c, o in zip(contexts, offsets, strict=True)]
    right = [np.frombuffer(c[o:], np.uint8)[: window].astype(np.int64) + 1 for c, o in zip(contexts, offsets, strict=True)]
    side = 257 + g
    parts = []
    for marks, sides in ((side, left), (side + len(groups), right)):
        for mark, s in zip(marks, sides, strict=True):
            parts += [s[::-1], [mark, 0]]
    symbols = np.concatenate(parts).astype(np.int64)
    closes = np.flatnonzero(symbols == 0)
    index = RunIndex(symbols, np.repeat(closes, np.diff(closes, prepend=-1)) - np.arange(len(symbols)))
    before = index.matching_statistics(side, left, max(map(len, left)))
    after = index.matching_statistics(side + len(groups), right, window)
    counts = np.array([len(c) - window + 1 for c in contexts])
    row = np.repeat(np.arange(len(contexts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    reach = offsets[row] - place  # how far the window begins before the shared text
    before, after = before[row, reach] + 1, after[row, window - reach] + 1
    most = index.n + 1
    if (window + 1) * most**2 < 1 << 63:
        name = (reach * most + before) * most + after
        order = np.argsort(name)
        new = np.append(True, name[order[1:]] != name[order[:-1]])
    else:
        names = np.stack([reach, before, after])
        order = np.lexsort(names)
        new = np.append(True, (names[:, order[1:]] != names[:, order[:-1]]).any(axis=0))
    seen = np.ones(len(row), bool)
    seen[np.minimum.reduceat(order, np.flatnonzero(new))] = False  # the first of equal windows
    return np.split(seen, np.cumsum(counts)[:-1])
