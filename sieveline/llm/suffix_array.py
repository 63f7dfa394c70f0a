"""A suffix array by induced sorting, and capped permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the empty suffix is the smallest."""
    n = len(t)
    up = np.zeros(n, bool)
    if n > 1:
        differs = t[:-1] != t[1:]
        at = np.flatnonzero(differs)
        # each position looks at the next change to its right; the last run is of the larger type
        nxt = np.searchsorted(at, np.arange(n - 1))
        inside = nxt < len(at)
        where = at[np.minimum(nxt, max(len(at) - 1, 0))] if len(at) else np.zeros(n - 1, np.int64)
        up[:-1] = inside & (t[where] < t[np.minimum(where + 1, n - 1)]) if len(at) else False
    return up


def lms_positions(up: np.ndarray) -> np.ndarray:
    return np.flatnonzero(up[1:] & ~up[:-1]) + 1


class Buckets:
    """Suffixes in order of arrival, by first symbol."""

    def __init__(self, symbols: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def put(self, rows: np.ndarray, symbol: np.ndarray) -> None:
        order = np.argsort(symbol, kind="stable")
        rows, symbol = rows[order], symbol[order]
        cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        for part in np.split(np.arange(len(rows)), cuts) if len(rows) else ():
            self.parts[symbol[part[0]]].append(rows[part])

    def take(self, c: int) -> np.ndarray | None:
        """What came to c since the last call."""
        got, self.parts[c] = self.parts[c], []
        return np.concatenate(got) if got else None


def induce(t: np.ndarray, up: np.ndarray, lms: np.ndarray, symbols: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From sorted starts of smaller suffixes, all larger suffixes and then all smaller ones, by bucket: both ascending."""
    seeds, large, small = Buckets(symbols), Buckets(symbols), Buckets(symbols)
    seeds.put(lms, t[lms])
    large.put(np.array([len(t) - 1]), t[-1:])
    larger, smaller, none = [], [], np.zeros(0, np.int64)
    for c in range(symbols):
        own = []
        while (rows := large.take(c)) is not None:  # each round induces the next symbols of a run
            own.append(rows)
            before = rows[rows > 0] - 1
            before = before[~up[before]]
            large.put(before, t[before])
        larger.append(np.concatenate(own) if own else none)
        if (rows := seeds.take(c)) is not None:
            before = rows[rows > 0] - 1
            before = before[~up[before]]
            large.put(before, t[before])
    for c in range(symbols - 1, -1, -1):  # from right to left: largest first
        own = []
        while (rows := small.take(c)) is not None:
            own.append(rows)
            before = rows[rows > 0] - 1
            before = before[up[before]]
            small.put(before, t[before])
        smaller.append(np.concatenate(own)[::-1] if own else none)
        rows = larger[c][::-1]
        before = rows[rows > 0] - 1
        before = before[up[before]]
        small.put(before, t[before])
    return larger, smaller[::-1]


def one_by_one(t: np.ndarray, up: np.ndarray, symbols: int):
    """The same for large alphabets, with a place for each suffix: a function of the sorted starts."""
    n, none = len(t), np.zeros(1, bool)
    ends = np.cumsum(np.bincount(t, minlength=symbols))
    heads, tails = np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()
    symbol, before = t.tolist(), np.concatenate(([0], t[:-1])).tolist()  # of the suffix, and of the one that begins one place earlier
    larger, smaller = (np.concatenate((none, kind[:-1], none)).tolist() for kind in (~up, up))  # whether that is of the type; a free place, -1, has none

    def induced(lms: list[int]) -> list[int]:
        sa, at = [-1] * n, tails[:]
        for j in reversed(lms):
            at[symbol[j]] -= 1
            sa[at[symbol[j]]] = j
        at = heads[:]
        sa[at[symbol[-1]]] = n - 1  # the empty suffix comes first and induces the last one
        at[symbol[-1]] += 1
        for j in sa:  # sees what is put further on
            if larger[j]:
                c = before[j]
                sa[at[c]] = j - 1
                at[c] += 1
        at = tails[:]
        for j in reversed(sa):
            if smaller[j]:
                c = before[j]
                at[c] -= 1
                sa[at[c]] = j - 1
        return sa

    return induced


def substring_names(t: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The rank of each smaller-leftmost substring of a large alphabet, symbol by symbol among those that are still equal.

    Of two that are equal as far as the shorter one goes, the shorter is larger: its last symbol begins a smaller suffix, the other's a larger
    one. The last substring ends at the end of the text, before which nothing comes.
    """
    n, m = len(t), len(lms)
    length, end = np.diff(np.append(lms, n)) + 1, np.full(m, symbols + 1)
    length[-1], end[-1] = n - lms[-1], 0
    name, active, step = t[lms].astype(np.int64), np.arange(m), 0
    order = np.argsort(name, kind="stable")
    while True:
        ranked = name[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        rank = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        lowest = np.empty(len(order), np.int64)
        lowest[order] = rank
        if not step:
            base = lowest
        else:
            base[active] = first[lowest] + (lowest - start[lowest])
        size = np.bincount(base[active], minlength=m)
        tied = (size[base[active]] > 1) & (step < length[active])
        active, step = active[tied], step + 1
        if not len(active):
            return np.unique(base, return_inverse=True)[1]
        groups, group = np.unique(base[active], return_inverse=True)
        name = group * (symbols + 2) + np.where(step < length[active], t[np.minimum(lms[active] + step, n - 1)] + 1, end[active])
        order = np.argsort(name, kind="stable")
        count = np.bincount(group)
        start, first = np.repeat(np.cumsum(count) - count, count), np.repeat(groups, count)


def names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each smaller-leftmost substring; `order` sorts lms, equal substrings get one name."""
    n, length = len(t), np.diff(np.append(lms, len(t) - 1)) + 1
    a, b = lms[order[1:]], lms[order[:-1]]
    la, lb = length[order[1:]], length[order[:-1]]
    same = la == lb
    # the last one ends at the end of the text and equals no other
    last = len(lms) - 1
    same &= (order[1:] != last) & (order[:-1] != last)
    active, step = np.flatnonzero(same), 0
    while len(active):
        active = active[step < la[active]]
        ok = t[np.minimum(a[active] + step, n - 1)] == t[np.minimum(b[active] + step, n - 1)]
        same[active[~ok]] = False
        active, step = active[ok], step + 1
    out = np.empty(len(lms), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(~same)))
    return out


def suffix_array(t: np.ndarray, symbols: int, small_alphabet: int = 300) -> np.ndarray:
    """The starts of all suffixes of t (values below `symbols`) in ascending order."""
    t = np.asarray(t)
    if not len(t):
        return np.zeros(0, np.int64)
    up = suffix_types(t)
    lms = lms_positions(up)
    large = one_by_one(t, up, symbols) if symbols > small_alphabet else None

    def induced(rows: np.ndarray) -> np.ndarray:
        if large:
            return np.asarray(large(rows.tolist()))
        larger, smaller = induce(t, up, rows, symbols)
        return np.concatenate([x for pair in zip(larger, smaller, strict=True) for x in pair])

    if len(lms):
        if large:
            name = substring_names(t, lms, symbols)
        else:
            place = np.full(len(t), -1, np.int64)
            place[lms] = np.arange(len(lms))
            order = place[induced(lms)]
            name = names(t, lms, order[order >= 0])
        count = int(name.max()) + 1
        if count < len(lms):
            lms = lms[suffix_array(name, count, small_alphabet)]
        else:
            lms = lms[np.argsort(name)]
    return induced(lms)


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, known: np.ndarray | None = None) -> np.ndarray:
    """How many bytes the suffixes at a and b share, at most cap; `known`: so many are known to be shared."""
    padded = np.concatenate([t.astype(np.uint8), np.zeros(cap + 16, np.uint8)])
    words = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
    out = np.zeros(len(a), np.int64) if known is None else known.copy()
    limit = np.minimum(cap, len(t) - np.maximum(a, b))
    active = np.flatnonzero(out < limit)
    while len(active):
        x = words[a[active] + out[active]] ^ words[b[active] + out[active]]
        lowest = x & (~x + np.uint64(1))
        out[active] += np.where(x == 0, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64)
        active = active[(x == 0) & (out[active] < limit[active])]
    return np.minimum(out, np.maximum(limit, 0))


def repeats(t: np.ndarray, sa: np.ndarray, length: int, every: int = 16) -> np.ndarray:
    """True at each start whose next `length` bytes also start elsewhere.

    Prefixes shared with the suffix before in the array are taken in the order of the text: a start shares at least one byte less than the
    start before it does. So every 16th is compared in full, which decides most of those between.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]], phi[sa[0]] = sa[:-1], -1
    sample = np.arange(0, n, every)
    has = phi[sample] >= 0
    shared = np.zeros(len(sample), np.int64)
    shared[has] = common_prefixes(t, sample[has], phi[sample[has]], length + every)
    i = np.arange(n)
    low = np.maximum(shared[i // every] - i % every, 0)
    after = np.append(shared[1:], 0)[i // every]
    capped = after >= length + every
    high = np.where(capped, n, after + every - i % every)
    yes = low >= length
    open_ = np.flatnonzero(~yes & (high >= length) & (phi >= 0) & (i % every > 0))
    if len(open_):
        yes[open_] = common_prefixes(t, open_, phi[open_], length, np.minimum(low[open_], length)) >= length
    yes &= phi >= 0
    out = yes.copy()
    out[phi[yes]] = True
    return out
