"""A run-length compressed Burrows-Wheeler index of many short segments, in NumPy.

Segments are rows of a byte matrix, symbols above 0, each followed by an end mark that is smaller
than every symbol and ordered by row. Of the transform the index keeps its runs: their
symbol, where they start (a bit vector with block ranks), the row their first symbol maps to, and
the suffix positions at both run ends. Beside them it holds the text, eight symbols of each suffix and the
suffix order, some 13 bytes a symbol, to compare samples directly and to tell groups. Matching statistics of patterns stream through it from
right to left, all patterns in step: a row in a run of the wanted symbol follows the mapping; any
other jumps to the nearer run end of that symbol, above or below, whichever sample shares more of
the current match.
"""

from __future__ import annotations

import numpy as np


class Ranks:
    """Counts of set bits up to a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def upto(self, at: np.ndarray) -> np.ndarray:
        """Set bits at positions <= ``at``."""
        word = at >> 6
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (at & 63).astype(np.uint64))
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class RunIndex:
    def __init__(self, segments: np.ndarray, window: int):
        """Index ``segments`` (rows of symbols, padded with 0 on either side); ``window`` is the
        length whose occurrences ``groups`` tells apart."""
        n_rows, width = segments.shape
        self.width = width + 1
        text = np.zeros((n_rows, self.width), np.uint8)
        text[:, :width] = segments
        text = self.text = text.reshape(-1)
        n = len(text)
        key = text.astype(np.uint64)
        for by in (1, 2, 4):
            shifted = np.zeros((n_rows, self.width), np.uint64)
            shifted[:, : self.width - by] = key.reshape(n_rows, self.width)[:, by:]
            key = key << np.uint64(8 * by) | shifted.reshape(-1)
        self.eight = key
        order, half = self._sorted(key)
        self.order = order
        pair = half.astype(np.int64).reshape(n_rows, self.width) * (n + 1)
        pair[:, : self.width - (window - 32)] += half.reshape(n_rows, self.width)[:, window - 32 :]
        pair = pair.reshape(-1)[order]
        new_group = np.concatenate([[True], pair[1:] != pair[:-1]])
        self.group_of = Ranks(new_group)
        self.group_start = np.flatnonzero(new_group)
        bwt = text[order - 1]  # an end mark stands before each row
        first = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        start = np.flatnonzero(first)
        end = np.concatenate([start[1:], [n]]) - 1
        self.run_of, self.start, self.end, self.head = Ranks(first), start, end, bwt[start]
        self.sample_start, self.sample_end = order[start], order[end]
        by_symbol = np.argsort(self.head, kind="stable")
        mapped = np.empty(len(start), np.int64)
        size = (end - start + 1)[by_symbol]
        # rows of the first column are ordered by symbol, within a symbol by the run
        mapped[by_symbol] = np.cumsum(size) - size
        self.mapped = mapped
        self.jump = self.head[by_symbol].astype(np.int64) * len(start) + by_symbol

    def _sorted(self, eight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix order, rank of each suffix by 32 symbols); ``eight`` holds 8 symbols of each.

        Prefix doubling over the suffixes whose place is still open. Nothing past an end mark
        counts: every suffix that starts with padding or an end mark is the empty one. Equal
        suffixes are ordered by position.
        """
        n, width = len(eight), self.width
        blank = self.text == 0
        eight = np.where(blank, np.uint64(0), eight)
        order = np.argsort(eight).astype(np.int32)
        place = np.arange(n, dtype=np.int32)
        column = np.tile(np.arange(width, dtype=np.int16), n // width)

        def starts(ranked: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The place where each one's group starts, and whether the group is more than one."""
            first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            head = np.flatnonzero(first)
            size = np.diff(np.append(head, len(ranked)))
            return np.repeat(at[head], size), np.repeat(size > 1, size)

        rank = np.empty(n, np.int32)
        group, several = starts(eight[order], place)
        rank[order] = group
        n_blank = int(blank.sum())
        order[:n_blank] = np.flatnonzero(blank)
        several[:n_blank] = False
        at, length, half = np.flatnonzero(several), 8, None
        while length < width:
            if length == 32:
                half = rank.copy()
            if len(at):
                open_ = order[at]
                key = rank[open_].astype(np.int64) * (n + 1)
                some = np.flatnonzero(column[open_] < width - length)
                key[some] += rank[open_[some] + length]
                sub = np.argsort(key)
                order[at] = open_ = open_[sub]
                group, several = starts(key[sub], at)
                rank[open_] = group
                at = at[several]
            length *= 2
        if len(at):
            open_ = order[at]
            order[at] = open_[np.argsort(rank[open_].astype(np.int64) * (n + 1) + open_)]
        return order, rank if half is None else half

    def groups(self, doc: np.ndarray) -> np.ndarray:
        """The smallest of ``doc`` (one per segment) in each group of equal windows."""
        return np.minimum.reduceat(np.repeat(doc, self.width)[self.order], self.group_start)

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b`` share, up to ``most``; none of ``most``
        symbols at one of them is an end mark."""
        out, n = np.zeros(len(a), np.int64), len(self.text) - 1
        open_ = np.flatnonzero(most > 0)
        for s in range(0, self.width, 8):
            differ = self.eight[np.minimum(a[open_] + s, n)] ^ self.eight[np.minimum(b[open_] + s, n)]
            equal = np.zeros(len(open_), np.int64)
            for k in range(8):
                equal += differ < np.uint64(1 << 8 * k)
            out[open_] = s + equal
            open_ = open_[(differ == 0) & (most[open_] > s + 8)]
            if not len(open_):
                break
        return np.minimum(out, most)

    def statistics(self, patterns: np.ndarray):
        """Right to left, for each column: (column, length, row) of the longest match that starts
        there, for all ``patterns``. A 0 in a pattern matches nothing and ends the match."""
        n, runs = len(patterns), len(self.start)
        row, at, length = np.zeros(n, np.int64), np.full(n, self.order[0]), np.zeros(n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column].astype(np.int64)
            run = self.run_of.upto(row) - 1
            differ = np.flatnonzero(self.head[run] != symbol)
            if len(differ):
                want, here = symbol[differ], run[differ].astype(np.int64)
                k = np.searchsorted(self.jump, want * runs + here)
                below, above = np.minimum(k, runs - 1), np.maximum(k - 1, 0)
                has_below, has_above = (self.jump[below] // runs == want) & (k < runs), (self.jump[above] // runs == want) & (k > 0)
                next_, last = self.jump[below] % runs, self.jump[above] % runs
                shared_below, shared_above = np.full(len(differ), -1), np.full(len(differ), -1)
                some = np.flatnonzero(has_below)
                shared_below[some] = self._shared(self.sample_start[next_[some]], at[differ[some]], length[differ[some]])
                some = np.flatnonzero(has_above)
                shared_above[some] = self._shared(self.sample_end[last[some]], at[differ[some]], length[differ[some]])
                up = shared_above >= shared_below
                row[differ] = np.where(up, self.end[last], self.start[next_])
                at[differ] = np.where(up, self.sample_end[last], self.sample_start[next_])
                length[differ] = np.maximum(np.maximum(shared_above, shared_below), 0)
                run[differ] = np.where(up, last, next_)
                lost = differ[~(has_below | has_above) | (want == 0)]
            else:
                lost = differ
            row = self.mapped[run] + row - self.start[run]
            at, length = at - 1, length + 1
            stop = symbol == 0
            stop[lost] = True
            if stop.any():
                row[stop], at[stop], length[stop] = 0, self.order[0], 0
            yield column, length, row
