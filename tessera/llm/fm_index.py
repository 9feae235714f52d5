"""A compressed full-text index of word sequences, and matching statistics by backward search.

Kept are the Burrows-Wheeler transform as bits of a wavelet matrix, the common prefix lengths of
neighbouring suffixes in a byte each, and the owners' range minima. Suffixes themselves aren't.
"""

from __future__ import annotations

import numpy as np

#: Matches of up to so many symbols are searched anew rather than looked up among the common prefixes: their intervals are wide.
SHALLOW = 3
_BLOCK = 16


class WaveletMatrix:
    """Counts of a symbol before a position, from bit vectors in 64-bit blocks with a running count each."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.blocks, self.counts, self.zeros = [], [], []
        now, n = symbols, len(symbols)
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            block = np.packbits(padded, bitorder="little").view(np.uint64)
            self.blocks.append(block)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(block))[:-1])).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))
        every = np.arange(n_symbols)
        self.starts = self._walk(every, np.zeros(n_symbols, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block, within = at >> 6, (at & 63).astype(np.uint64)
        return self.counts[level][block] + np.bitwise_count(self.blocks[level][block] & ((np.uint64(1) << within) - np.uint64(1)))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position of the sequence comes to lie, level by level, on the path of a symbol."""
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = self._ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position beside it."""
        return self._walk(symbol, at) - self.starts[symbol]


class RangeMin:
    """The least value of any range, from minima within small blocks and over runs of 2**k blocks."""

    def __init__(self, values: np.ndarray):
        rows = np.full((len(values) // _BLOCK + 1, _BLOCK), np.iinfo(values.dtype).max, values.dtype)
        rows.ravel()[: len(values)] = values
        self.values = rows.ravel()
        self.ahead = np.minimum.accumulate(rows, axis=1).ravel()
        self.back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
        runs = [rows.min(axis=1)]
        while 2 << len(runs) - 1 <= len(rows):
            reach, last = 1 << len(runs) - 1, runs[-1]
            wider = last.copy()
            wider[:-reach] = np.minimum(last[:-reach], last[reach:])
            runs.append(wider)
        self.runs = np.stack(runs)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value at low to high - 1; no range is empty."""
        a, b = low // _BLOCK, (high - 1) // _BLOCK
        out = np.minimum(self.back[low], self.ahead[high - 1])
        far = np.flatnonzero(b - a > 1)
        if len(far):
            level = np.log2(b[far] - a[far] - 1).astype(np.int64)
            out[far] = np.minimum(out[far], np.minimum(self.runs[level, a[far] + 1], self.runs[level, b[far] - (1 << level)]))
        same = np.flatnonzero(a == b)
        if len(same):
            at = low[same, None] + np.arange(_BLOCK)
            inside = at < high[same, None]
            out[same] = np.where(inside, self.values[np.where(inside, at, low[same, None])], np.iinfo(out.dtype).max).min(axis=1)
        return out


class FmIndex:
    """Index of sequences (one array, symbol 0 after each) for patterns of up to ``depth`` symbols, with the owner of each place.

    Suffixes are sorted by at least their first ``depth`` symbols, which is all that the borders
    of such a pattern's interval depend on.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, owners: np.ndarray, depth: int):
        n = self.n = len(text)
        rank, reach, ranks = text.astype(np.int64), 1, []
        while True:
            ranks.append((reach, rank.astype(np.int32)))
            if reach >= depth:
                break
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            both = rank * (n + n_symbols + 2) + after
            order = np.argsort(both)  # ties may stand in any order: they agree on as many symbols as are looked at
            key = both[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
            reach *= 2
        if len(ranks) == 1:
            order = np.argsort(rank, kind="stable")
        common = np.zeros(n - 1, np.int32)  # of neighbours in order, by halving steps
        for reach, rank in reversed(ranks):
            x, y = order[:-1] + common, order[1:] + common
            inside = np.maximum(x, y) < n
            common += reach * (inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)]))
        self.common = np.concatenate(([0], np.minimum(common, depth), [0])).astype(np.uint8 if depth < 256 else np.int32)
        self.wavelet = WaveletMatrix(text[order - 1], n_symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.owners = RangeMin(owners[order])

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of symbol + pattern from those of pattern."""
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.before[symbol] + both[: len(low)], self.before[symbol] + both[len(low) :]

    def widen(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``size`` (one or more) symbols of the patterns."""
        return self._edge(low, size, -1), self._edge(high, size, 1)

    def _edge(self, at: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
        """The nearest border, from a place on, between suffixes that share fewer than ``size`` symbols."""
        at, left, reach = at.copy(), np.arange(len(at)), 8
        while len(left):
            look = np.clip(at[left, None] + step * np.arange(reach), 0, self.n)
            stop = self.common[look] < size[left, None]
            first = stop.argmax(axis=1)
            found = stop[np.arange(len(left)), first]
            at[left] = np.clip(at[left] + step * np.where(found, first, reach), 0, self.n)
            left = left[~found]
            reach = min(4 * reach, max(8, 4_000_000 // max(1, len(left))))
        return at

    def _try(self, low, high, symbol, owner):
        """extend(), and which of the longer patterns stand in a sequence of a smaller owner."""
        a, b = self.extend(low, high, symbol)
        good = (symbol > 0) & (a < b)
        at = np.flatnonzero(good)
        good[at] = self.owners.least(a[at], b[at]) < owner[at]
        return a, b, good

    def _shorten(self, low, high, text, place):
        """Intervals and lengths of the longest prefixes of the patterns that occur more often than these. Patterns begin right of ``place``."""
        size = np.maximum(self.common[low], self.common[high]).astype(np.int64)
        a, b = np.zeros_like(low), np.full_like(high, self.n)
        deep = size > SHALLOW
        a[deep], b[deep] = self.widen(low[deep], high[deep], size[deep])
        for k in range(1, SHALLOW + 1):
            own = np.flatnonzero(size == k)
            for i in range(k, 0, -1):
                a[own], b[own] = self.extend(a[own], b[own], text[place[own] + i])
        return a, b, size

    def statistics(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, window: int, patient: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(length of the longest match from each place on, at most ``window``; sequences that were given up).

        Matches count in sequences of smaller owners only. text holds the streamed sequences,
        starts to ends, with symbol 0 for what the index doesn't know. All are read backward at once. A
        sequence is left when none of its windows can match any more, without patience at its first mismatch.
        """
        length, gone = np.zeros(len(text), np.uint8 if window < 256 else np.int32), []
        who, place = np.arange(len(starts)), ends - 1
        low, high, size = np.zeros(len(who), np.int64), np.full(len(who), self.n), np.zeros(len(who), np.int64)
        while len(who):
            a, b, good = self._try(low, high, text[place], owner[who])
            low, high, size = np.where(good, a, low), np.where(good, b, high), size + good
            length[place[good]] = size[good]
            full = np.flatnonzero(size == window)
            if len(full):
                size[full] -= 1
                low[full], high[full] = self.widen(low[full], high[full], size[full])
            bad = np.flatnonzero(~good)
            move = good.copy()
            if len(bad) and patient:
                move[bad[size[bad] == 0]] = True
                some = bad[size[bad] > 0]
                low[some], high[some], size[some] = self._shorten(low[some], high[some], text, place[some])
            elif len(bad):
                gone.append(who[bad])
            place = place - move
            stay = (place >= starts[who]) & (place + 1 + size >= starts[who] + window)
            if not patient:
                stay &= good
            who, place, low, high, size = who[stay], place[stay], low[stay], high[stay], size[stay]
        return length, np.concatenate(gone) if gone else np.empty(0, np.int64)

    def first_windows(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
        """Where the first window of each sequence that a smaller owner has begins; its end if none does.

        Windows are tried from the left, each backward from its end; a run of words that doesn't
        occur rules out all windows over it at once.
        """
        out, who, begin = ends.copy(), np.arange(len(starts)), starts.copy()
        place, low, high = begin + window - 1, np.zeros(len(who), np.int64), np.full(len(who), self.n)
        while len(who):
            a, b, good = self._try(low, high, text[place], owner[who])
            found = good & (place == begin)
            out[who[found]] = begin[found]
            begin = np.where(good, begin, place + 1)
            place = np.where(good, place - 1, begin + window - 1)
            low, high = np.where(good, a, 0), np.where(good, b, self.n)
            stay = ~found & (begin + window <= ends[who])
            who, begin, place, low, high = who[stay], begin[stay], place[stay], low[stay], high[stay]
        return out

    def repeated(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
        """Places of text from which a window on stands in a sequence of a smaller owner.

        Most sequences match throughout or nowhere. So those with a mismatch are looked at again
        from their first window that matches, if there is one.
        """
        length, gone = self.statistics(text, starts, ends, owner, window, patient=False)
        first = self.first_windows(text, starts[gone], ends[gone], owner[gone], window)
        alive = first < ends[gone]
        again, _ = self.statistics(text, first[alive], ends[gone[alive]], owner[gone[alive]], window)
        return np.maximum(length, again) == window
