"""Two compressed indexes over a set of short contents, in numpy.

Both are built from a sorted array of all suffixes, keep the Burrows-Wheeler transform in
compressed form and drop the array.  Every content is then streamed through the index of all
contents of the shard, from its end, and each of its windows gets an interval of rows: that of all
suffixes which begin with the window.  The places of an interval are the window's occurrences.

``RunLengthIndex`` keeps the transform's runs with the suffixes at both of their ends.  A content's
row moves one unit to the left by its run alone, and with it the matching statistic of the row
against the row before it: inside a run the match grows by one unit, and at a run's start it is that
of two sampled suffixes, whose units are compared.

``WaveletIndex`` keeps the transform as a wavelet matrix.  A content's interval moves one unit to the
left by backward search of its first row, a rank on each level of two bits; once it is ``width`` units deep, the deeper
match is widened again to all rows that share ``width`` units.  As every content stands in the index, no
interval is empty and its first row doesn't depend on its last one, so the last row isn't searched: it is the one before the next
interval of ``width`` units.

All contents are streamed at once, a step of all of them being one numpy expression.
"""

from __future__ import annotations

import numpy as np


def order_of(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of numbers from 0 to ``most``, and the numbers in it; places ride in the low bits where they fit, as sorting numbers is faster than sorting places."""
    bits = max(len(key) - 1, 1).bit_length()
    if most.bit_length() + bits > 63:
        by = np.argsort(key, kind="stable")
        return by, key[by]
    packed = key << bits | np.arange(len(key))
    packed.sort()
    return packed & ((1 << bits) - 1), packed >> bits


def sort_suffixes(units: np.ndarray, separators: int = 0) -> np.ndarray:
    """Order of all suffixes by prefix doubling.

    ``units`` are small numbers and must have separators that are all different, one of them at the end.  If these
    are the numbers below ``separators``, in order of place, the first sort is by several units at once.
    """
    n = len(units)
    if not n:
        return np.zeros(0, np.int64)
    symbols = np.maximum(units - separators + 1, 0) if separators else units + 1
    bits, size = max(int(symbols.max()).bit_length(), 1), 1
    if separators:
        size = max((63 - n.bit_length()) // bits, 1)
    # units are put side by side by doubling; what stands behind a separator doesn't count, as separators are all different
    key, have, pair, of = None, 0, symbols, 1
    while have < size:
        if (size & of) and of <= size:
            key = pair if key is None else key << of * bits | np.append(pair[have:], np.zeros(min(have, n), np.int64))
            have += of
        if 2 * of <= size:
            pair = pair << of * bits | np.append(pair[of:], np.zeros(min(of, n), np.int64))
        of *= 2
    ended = np.zeros(n, bool)
    stops = np.flatnonzero(symbols == 0)
    for k in range(size):
        at = stops[stops >= k] - k
        at = at[~ended[at]]
        ended[at] = True
        key[at] = key[at] >> (size - 1 - k) * bits << (size - 1 - k) * bits
    open_, key = order_of(key, (1 << size * bits) - 1)
    fresh = np.ones(n, bool)
    fresh[1:] = (key[1:] != key[:-1]) | ended[open_[1:]]
    # a rank is the row of the first suffix that is equal so far; open suffixes share theirs with others, and keep their rows
    row = np.arange(n)
    shift, rank = n.bit_length(), np.empty(n, np.int32)
    while True:
        own = np.maximum.accumulate(np.where(fresh, row, 0))
        rank[open_] = own
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        open_, row, own = open_[shared], row[shared], own[shared]
        if not len(open_):
            break
        by, key = order_of(own << shift | rank[open_ + size], (1 << 2 * shift) - 1)
        open_ = open_[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = key[1:] != key[:-1]
        size *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def coded(values: np.ndarray, most: int = 1 << 16) -> tuple[np.ndarray, int]:
    """Numbers as their rank among those that occur, and how many occur; small numbers are told apart without a sort."""
    if len(values) and 0 <= values.min() and values.max() < most:
        occurs = np.bincount(values) > 0
        return (np.cumsum(occurs) - 1)[values], int(occurs.sum())
    known, ranks = np.unique(values, return_inverse=True)
    return ranks, len(known)


def match_lengths(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Units that the suffixes at ``a`` and ``b`` have in common at their start, at most ``most``."""
    out = np.full(len(a), most, np.int64)
    still = np.arange(len(a))
    for k in range(most):
        # separators are all different, so no match runs over the end of the text
        same = text[a] == text[b]
        if not same.all():
            out[still[~same]] = k
            still, a, b = still[same], a[same], b[same]
        if not len(still):
            break
        a, b = a + 1, b + 1
    return out


#: Bits of a word up to each of its places.
_UPTO = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - np.arange(64, dtype=np.uint64))
#: Bits of a word below each of its places.
_BELOW = np.append(np.uint64(0), _UPTO[:-1])


def _bits(n: int, places: np.ndarray) -> np.ndarray:
    """A bit for each of ``n`` places, in words."""
    padded = np.zeros((n // 64 + 1) * 64, np.uint8)
    padded[places] = 1
    return np.packbits(padded, bitorder="little").view(np.uint64)


class _Index:
    """What both indexes share: the text of all contents, where they end, and the streaming."""

    def __init__(self, contents: list[np.ndarray], width: int):
        self.width = width
        self.sizes = np.array([len(c) for c in contents], np.int64)
        d = len(contents)
        ranks, n_symbols = coded(np.concatenate(contents)) if d else (np.zeros(0, np.int64), 0)
        self.at = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        text = np.empty(self.at[-1], np.int64)
        ends = self.at[1:] - 1
        keep = np.ones(len(text), bool)
        keep[ends] = False
        text[keep] = ranks + d
        text[ends] = np.arange(d)  # separators: all different, and below every symbol
        self.text, self.n, self.n_symbols = text, len(text), d + n_symbols
        suffixes = sort_suffixes(text, d)
        self._keep(text[suffixes - 1], suffixes)

    def _keep(self, transform: np.ndarray, suffixes: np.ndarray) -> None:
        """Keep the transform in compressed form, and of the suffixes no more than samples."""
        raise NotImplementedError

    def _begin(self, contents: np.ndarray):
        """The state of streams that stand at the ends of ``contents``."""
        raise NotImplementedError

    def _step(self, state, active: int, places: np.ndarray) -> np.ndarray:
        """Move the first ``active`` streams to the units at ``places``; returns a row of each, for its interval."""
        raise NotImplementedError

    def _intervals(self, rows: np.ndarray) -> np.ndarray:
        """First rows of the intervals that hold ``rows``, once all contents were streamed."""
        raise NotImplementedError

    def stream(self) -> list[np.ndarray]:
        """For each content the first row of the interval of each of its windows."""
        d = len(self.sizes)
        flat_at = np.concatenate([[0], np.cumsum(np.maximum(self.sizes - self.width + 1, 0))]).astype(np.int64)
        flat = np.zeros(int(flat_at[-1]), np.int64)
        by_size = np.argsort(-self.sizes, kind="stable")
        sizes, end, at = self.sizes[by_size], self.at[by_size + 1] - 1, flat_at[by_size]
        state = self._begin(by_size)
        # contents of at least t units
        longest = int(sizes.max(initial=0))
        reaching = np.cumsum(np.bincount(sizes, minlength=longest + 1)[::-1])[::-1].tolist()
        for t in range(1, longest + 1):
            active = reaching[t]
            rows = self._step(state, active, end[:active] - t)
            if t >= self.width:
                flat[at[:active] + sizes[:active] - t] = rows
        flat = self._intervals(flat)
        return [flat[flat_at[k] : flat_at[k + 1]] for k in range(d)]


class RunLengthIndex(_Index):
    """Runs of the transform: first rows, heads, where each run's first row steps to, and the suffixes at run ends."""

    def _keep(self, transform, suffixes):
        first = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
        self.first, self.head = first, transform[first]
        lengths = np.diff(np.append(first, self.n))
        # rows are stepped to in order of symbol, then of row
        order = np.argsort(self.head.astype(np.uint16) if self.n_symbols <= 1 << 16 else self.head, kind="stable")  # numbers of 16 bits are sorted by digits
        self.target = np.empty(len(first), np.int64)
        self.target[order] = np.cumsum(lengths[order]) - lengths[order]
        self.first_sample, self.last_sample = suffixes[first], suffixes[np.append(first[1:], self.n) - 1]
        # the row before a run's target is where the last row of the run before it in this order steps to
        before, run = order[:-1], order[1:]
        self.match = np.zeros(len(first), np.int64)
        self.match[run] = match_lengths(self.text, self.first_sample[run] - 1, self.last_sample[before] - 1, self.width)
        # where runs begin, as a bit a row, with the number of runs before each word of bits
        self.words = _bits(self.n, first)
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words) - 1
        #: Whether a row shares ``width`` units with the one before it, as streams find out.
        self.joined = np.zeros(self.n, bool)

    def runs(self, rows: np.ndarray) -> np.ndarray:
        """Runs that hold rows."""
        word = rows >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _UPTO[rows & 63])

    def step(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that are one unit longer to the left."""
        run = self.runs(rows)
        return self.target[run] + rows - self.first[run]

    def _begin(self, contents):
        # the suffix that is a separator alone stands in the row of that separator, and matches nothing
        return [contents.copy(), np.zeros(len(contents), np.int64)]

    def _step(self, state, active, places):
        rows, match = state[0][:active], state[1][:active]
        run = self.runs(rows)
        into = rows - self.first[run]
        match[:] = np.where(into > 0, np.minimum(match + 1, self.width), self.match[run])
        rows[:] = self.target[run] + into
        self.joined[rows] = match == self.width
        return rows

    def _intervals(self, rows):
        return np.maximum.accumulate(np.where(self.joined, 0, np.arange(self.n)))[rows]

    def locate(self, row: int) -> int:
        """Place of the suffix in ``row``, by stepping to the end of a run."""
        steps = 0
        while True:
            run = int(np.searchsorted(self.first, row, "right")) - 1
            end = (self.first[run + 1] if run + 1 < len(self.first) else self.n) - 1
            if row == end:
                return int(self.last_sample[run] + steps) % self.n
            row = int(self.step(np.array([row]))[0])
            steps += 1


class WaveletIndex(_Index):
    """The transform as a wavelet matrix of two bits a level: for each digit a packed bit vector with block counts."""

    BLOCK = 64

    def _keep(self, transform, suffixes):
        self.levels, values = [], transform.astype(np.int64)
        size = self.n // self.BLOCK + 1
        digits = max(-(-int(self.n_symbols - 1).bit_length() // 2), 1)
        self.bits = [2 * k for k in reversed(range(digits))]
        for bit in self.bits:
            digit = values >> bit & 3
            places = [np.flatnonzero(digit == k) for k in range(4)]
            words = np.concatenate([_bits(self.n, p) for p in places])
            # a digit's block counts begin with the rows of all smaller digits
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            self.levels.append((words, counts))
            values = values[np.concatenate(places)]
        #: Where the digits of a symbol begin in ``words`` and ``counts``, by level.
        symbols = np.arange(self.n_symbols)
        self.digits = np.stack([(symbols >> bit & 3) * size for bit in self.bits])
        # a symbol's rows at the last level -> its rows among the sorted suffixes
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        total = np.bincount(transform, minlength=self.n_symbols)
        self.shift = np.zeros(self.n_symbols, np.int64)
        self.shift[values[starts]] = (np.cumsum(total) - total)[values[starts]] - starts
        #: Rows that don't share ``width`` units with the row before them.
        self.begin = np.concatenate([[0], 1 + np.flatnonzero(match_lengths(self.text, suffixes[:-1], suffixes[1:], self.width) < self.width), [self.n]])

    def search(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each bound of an interval the bound after one unit more to the left."""
        for begin, (words, counts) in zip(self.digits[:, symbols], self.levels):
            word = begin + (rows >> 6)
            rows = counts[word] + np.bitwise_count(words[word] & _BELOW[rows & 63])
        return rows + self.shift[symbols]

    def _begin(self, contents):
        # the empty match: all rows, of which 0 is the first
        return [np.zeros(len(contents), np.int64), 0]

    def _step(self, state, active, places):
        low = self.search(self.text[places], state[0][:active])
        state[1] += 1
        if state[1] >= self.width:
            low = self.begin[np.searchsorted(self.begin, low, "right") - 1]
        state[0][:active] = low
        return low

    def _intervals(self, rows):
        return rows
