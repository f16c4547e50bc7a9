"""Merging adjacent symbols by rank, for many words at once.

All words of one length form a matrix. In each round every word that still has a mergeable pair
merges its best one (lowest rank, leftmost), which is the order in which an agenda would process
each word by itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np

NOTHING = np.int64(2**62)
LONGEST = 48  # symbols; longer words go through an agenda one by one
BLOCK = 1 << 17  # symbols merged at a time, so that the matrices stay in cache
_EMPTY = np.uint64(2**64 - 1)
_32 = np.uint64(32)
_MERGED_AWAY = -2  # symbols are ids from 0, or -1 for one that never merges


class PairTable:
    """(left, right) -> rank * 2**38 + merged, as an open hash table that answers for arrays.

    With the column of the pair in the six bits between, the smallest value is the best merge.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = self._keys(left, right)
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.values = np.full(1 << bits, NOTHING, np.int64)
        values = (rank.astype(np.int64) << 38) | merged.astype(np.int64)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == _EMPTY
            _, first = np.unique(slots[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put)
            slots[todo] = (slots[todo] + np.uint64(1)) & self.mask

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << _32) | right.astype(np.uint32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Value of each pair of two flat arrays; ``NOTHING`` where they do not merge."""
        keys = self._keys(left, right)
        slots = self._slots(keys)
        held = self.keys[slots]
        value = self.values[slots]
        at = np.flatnonzero(held != keys)
        value[at] = NOTHING
        at = at[held[at] != _EMPTY]
        while len(at):
            slots[at] = (slots[at] + np.uint64(1)) & self.mask
            held = self.keys[slots[at]]
            hit = held == keys[at]
            value[at[hit]] = self.values[slots[at[hit]]]
            at = at[~hit & (held != _EMPTY)]
        return value


# Says for arrays of (start, middle, end) which candidate merges are to be skipped.
Skips = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def merged_words(
    symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: PairTable, skips: Skips | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and symbols of what is left of each word, in any order of words.

    Word i is ``symbols[starts[i] : starts[i] + lengths[i]]``.
    """
    order = np.argsort(lengths, kind="stable")
    each, first = np.unique(lengths[order], return_index=True)
    for length, a, b in zip(each.tolist(), first, [*first[1:], len(order)], strict=True):
        mine = starts[order[a:b]]
        if length == 1:
            yield mine, symbols[mine]
        elif length > LONGEST:
            for start in mine.tolist():
                yield _by_agenda(symbols, start, start + length, table, skips)
        else:
            step = max(1, BLOCK // length)
            for i in range(0, len(mine), step):
                yield _lockstep(symbols, mine[i : i + step], length, table, skips)


def _lockstep(symbols, starts, w, table, skips):
    n = len(starts)
    places = starts[:, None] + np.arange(w)
    ids = symbols[places]
    value = np.full((n, w), NOTHING)
    value[:, :-1] = table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, w - 1)
    value[:, :-1] |= np.arange(w - 1) << 32
    # Columns of the neighbours; flat views, addressed by row * w + column.
    after = np.tile(np.arange(1, w + 1, dtype=np.int64), n)
    before = np.tile(np.arange(-1, w - 1, dtype=np.int64), n)
    ids, flat = ids.ravel(), value.ravel()

    if skips is not None:
        row, column = np.nonzero(value < NOTHING)
        base = starts[row]
        flat[(row * w + column)[skips(base + column, base + column + 1, base + column + 2)]] = NOTHING
    rows = np.arange(n)
    while len(rows):
        best = value[rows].argmin(1) if len(rows) < n else value.argmin(1)
        origin = rows * w
        at = origin + best
        found = flat[at]
        go = found < NOTHING
        if not go.all():
            rows, best, origin, at, found = rows[go], best[go], origin[go], at[go], found[go]
            if not len(rows):
                break
        right = after[at]
        dead = origin + right
        end = after[dead]
        ids[at] = found & 0xFFFFFFFF
        ids[dead], flat[dead], flat[at] = _MERGED_AWAY, NOTHING, NOTHING
        after[at] = end
        has = end < w
        before[(origin + end)[has]] = best[has]
        left = before[at]
        # The pairs that have changed: with the one before and with the one behind.
        back = np.flatnonzero(left >= 0)
        ahead = np.flatnonzero(has)
        r = np.concatenate([back, ahead])
        a = np.concatenate([left[back], best[ahead]])
        b = np.concatenate([best[back], end[ahead]])
        at_a, at_b = origin[r] + a, origin[r] + b
        new = table.find(ids[at_a], ids[at_b])
        if skips is not None:
            k = np.flatnonzero(new != NOTHING)
            base = starts[rows[r[k]]]
            new[k[skips(base + a[k], base + b[k], base + after[at_b[k]])]] = NOTHING
        flat[at_a] = new | (a << 32)
    alive = ids != _MERGED_AWAY
    return places.ravel()[alive], ids[alive]


def _by_agenda(symbols, start, end, table, skips):
    """One long word, with a heap of candidate merges."""
    n = end - start
    ids = symbols[start:end].astype(np.int64).tolist()
    alive = [True] * n
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

    def candidates(lefts):
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        if not lefts:
            return
        rights = [after[i] for i in lefts]
        value = table.find(np.array([ids[i] for i in lefts]), np.array([ids[j] for j in rights]))
        ok = value != NOTHING
        if skips is not None and ok.any():
            place = [np.array(x, np.int64) + start for x in (lefts, rights, [after[j] for j in rights])]
            ok[ok] = ~skips(*[p[ok] for p in place])
        for k in np.flatnonzero(ok).tolist():
            rank, made = divmod(int(value[k]), 1 << 38)
            yield rank, lefts[k], rights[k], after[rights[k]], made

    heap = list(candidates(range(n - 1)))
    heapq.heapify(heap)
    while heap:
        _, i, j, k, made = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j]) or after[i] != j or after[j] != k:
            continue
        ids[i], alive[j], after[i] = made, False, k
        if k < n:
            before[k] = i
        for c in candidates([before[i], i]):
            heapq.heappush(heap, c)
    left = np.flatnonzero(alive)
    return left + start, np.array(ids, symbols.dtype)[left]
