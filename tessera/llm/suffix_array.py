"""Suffix arrays by induced sorting, and permuted longest common prefixes, on numpy."""

from __future__ import annotations

import numpy as np

#: Up to so many symbols, buckets are induced as whole arrays; beyond, entry by entry.
SMALL_ALPHABET = 600
#: Sequences of names shorter than this are ordered by doubled ranks: two ranks and a place fit 63 bits.
RANKED = 1 << 21


def _types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is_s, leftmost-S positions) of each suffix; the end counts as a smaller symbol."""
    n = len(s)
    is_s = np.zeros(n, dtype=bool)
    if n > 1:
        place = np.arange(n - 1, dtype=np.int64)
        decided = np.where(s[:-1] != s[1:], place, n - 1)
        decided = np.minimum.accumulate(decided[::-1])[::-1]
        known = decided < n - 1
        at = decided[known]
        is_s[:-1][known] = s[at] < s[at + 1]
    return is_s, np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _deal(buckets: list[list[np.ndarray]], entries: np.ndarray, symbols: np.ndarray) -> None:
    """Appends entries to their symbols' buckets in the order given."""
    order = np.argsort(symbols, kind="stable")
    entries, symbols = entries[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for part, c in zip(np.split(entries, cuts), symbols[np.concatenate(([0], cuts))]):
        buckets[c].append(part)


def _induce_arrays(s: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, from leftmost-S positions in order (``seeds``); a bucket at a time."""
    n = len(s)
    large: list[list[np.ndarray]] = [[] for _ in range(k)]
    small: list[list[np.ndarray]] = [[] for _ in range(k)]
    seeded: list[list[np.ndarray]] = [[] for _ in range(k)]
    if len(seeds):
        _deal(seeded, seeds, s[seeds])
    large[s[n - 1]].append(np.array([n - 1]))
    for c in range(k):
        at = 0
        while at < len(large[c]):  # grows while it is read: runs of one symbol
            now = large[c][at] if at + 1 == len(large[c]) else np.concatenate(large[c][at:])
            at = len(large[c])
            before = now[now > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _deal(large, before, s[before])
        for now in seeded[c]:
            before = now - 1
            _deal(large, before, s[before])
    for c in range(k - 1, -1, -1):
        at = 0
        while at < len(small[c]):
            now = small[c][at] if at + 1 == len(small[c]) else np.concatenate(small[c][at:])
            at = len(small[c])
            before = now[now > 0] - 1
            before = before[is_s[before]]
            if len(before):
                _deal(small, before, s[before])
        if large[c]:
            now = np.concatenate(large[c])[::-1]
            before = now[now > 0] - 1
            before = before[is_s[before]]
            if len(before):
                _deal(small, before, s[before])
    parts = []
    for c in range(k):
        parts += large[c]
        if small[c]:
            parts.append(np.concatenate(small[c])[::-1])
    return np.concatenate(parts)


def _induce_entries(s: list[int], larger: list[int], smaller: list[int], seeds: list[int], sizes: np.ndarray) -> list[int]:
    """The same, an entry at a time, for alphabets too large to go through by symbol.

    ``larger`` and ``smaller`` have for each position the one before it if that is of the
    type, else -1; their last element stands for an empty place.
    """
    n = len(s)
    ends = np.cumsum(sizes)
    tails, heads = (ends - 1).tolist(), (ends - sizes).tolist()
    order = [-1] * n
    tail = tails[:]
    for j in reversed(seeds):
        c = s[j]
        at = tail[c]
        order[at] = j
        tail[c] = at - 1
    c = s[n - 1]
    order[heads[c]] = n - 1
    heads[c] += 1
    for i in order:  # reads what the loop has written
        j = larger[i]
        if j >= 0:
            c = s[j]
            at = heads[c]
            order[at] = j
            heads[c] = at + 1
    for i in reversed(order):
        j = smaller[i]
        if j >= 0:
            c = s[j]
            at = tails[c]
            order[at] = j
            tails[c] = at - 1
    return order


def _by_ranks(names: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``names`` in order: ranks of their first 1, 2, 4, ... symbols, until all differ."""
    n = len(names)
    bits = np.int64(n.bit_length())
    here, rank, step = np.arange(n, dtype=np.int64), names + 1, 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)  # 0: past the end, smaller than any rank
        ahead[: max(0, n - step)] = rank[step:]
        key = np.sort((rank << bits | ahead) << bits | here)
        order, pair = key & ((np.int64(1) << bits) - 1), key >> bits
        ranks = np.concatenate(([1], 1 + np.cumsum(pair[1:] != pair[:-1])))
        if ranks[-1] == n:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = ranks
        step *= 2


def suffix_array(s: np.ndarray, k: int, entries: bool = False) -> np.ndarray:
    """The starts of the suffixes of ``s`` (symbols 0 .. k - 1) in order.

    Suffixes are classified as larger or smaller than their successor; substrings between
    leftmost smaller ones are sorted by inducing and named; the sequence of names is sorted by
    doubled ranks, or by the same function if it is too long for them; from its order the whole array is induced in linear time.
    With ``entries`` it is induced entry by entry whatever the alphabet: better for long runs over few symbols.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    is_s, leftmost = _types(s)
    if k <= SMALL_ALPHABET and not entries:

        def induce(seeds: np.ndarray) -> np.ndarray:
            return _induce_arrays(s, is_s, seeds, k)
    else:
        symbols, sizes = s.tolist(), np.bincount(s, minlength=k)
        before = np.arange(-1, n)
        flags = np.concatenate(([False], is_s))
        smaller = np.where(flags, before, -1)
        larger = np.where(flags, -1, before)
        smaller[n] = larger[n] = -1
        smaller, larger = smaller.tolist(), larger.tolist()

        def induce(seeds: np.ndarray) -> np.ndarray:
            # seeds lie in their buckets in the order given
            return np.array(_induce_entries(symbols, larger, smaller, seeds.tolist(), sizes))

    if len(leftmost) == 0:
        return induce(leftmost)
    if len(leftmost) > 1:
        # order of the substrings, each up to and with the next leftmost-S position
        marked = np.zeros(n, dtype=bool)
        marked[leftmost] = True
        order = induce(leftmost)
        order = order[marked[order]]
        length = np.zeros(n, dtype=np.int64)
        length[leftmost[:-1]] = np.diff(leftmost) + 1
        length[leftmost[-1]] = n + 1  # ends with the end of the text: like no other
        a, b = order[:-1], order[1:]
        differ = length[a] != length[b]
        active = np.flatnonzero(~differ)
        offset = 0
        while len(active):
            x, y = a[active] + offset, b[active] + offset
            unlike = s[x] != s[y]
            differ[active[unlike]] = True
            offset += 1
            active = active[~unlike & (length[a[active]] > offset)]
        names = np.zeros(n, dtype=np.int64)
        names[order[1:]] = np.cumsum(differ)
        reduced = names[leftmost]
        kinds = int(differ.sum()) + 1
        if kinds == len(leftmost):
            sorted_leftmost = order
        else:
            sorted_leftmost = leftmost[_by_ranks(reduced) if len(reduced) < RANKED else suffix_array(reduced, kinds)]
    else:
        sorted_leftmost = leftmost
    return induce(sorted_leftmost)


def permuted_lcp(s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): phi has each suffix's neighbour before it in order (-1: none), plcp their common prefix.

    Only irreducible values, where the symbols before the two differ, are compared symbol
    by symbol; any other is one less than the value at the position before it.
    """
    n = len(s)
    phi = np.full(n, -1, dtype=np.int64)
    phi[order[1:]] = order[:-1]
    irreducible = np.ones(n, dtype=bool)
    if n > 1:
        here = np.arange(1, n)
        other = phi[1:]
        both = other > 0
        irreducible[1:][both] = s[here[both] - 1] != s[other[both] - 1]
    wide = 4 if n and s.max() < 65_535 else 2
    padded = np.concatenate([s.astype(np.uint64) + np.uint64(1), np.zeros(wide, dtype=np.uint64)])
    word = padded[: n + 1].copy()
    for k in range(1, wide):
        word |= padded[k : n + 1 + k] << np.uint64(64 // wide * k)
    plcp = np.zeros(n, dtype=np.int64)
    active = np.flatnonzero(irreducible & (phi >= 0))
    while len(active):  # four or two symbols at a time
        x, y = active + plcp[active], phi[active] + plcp[active]
        same = word[np.minimum(x, n)] == word[np.minimum(y, n)]
        inside = np.maximum(x, y) + wide <= n
        go = same & inside
        plcp[active[go]] += wide
        left = active[~go]
        for _ in range(wide - 1):
            x, y = left + plcp[left], phi[left] + plcp[left]
            fits = np.maximum(x, y) < n
            left, x, y = left[fits], x[fits], y[fits]
            left = left[s[x] == s[y]]
            plcp[left] += 1
        active = active[go]
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    return plcp[last] - (np.arange(n) - last), phi
