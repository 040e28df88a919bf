"""Suffix sorting with a difference cover, one block of suffixes at a time.

The suffixes at a difference cover's places are ranked first. Then blocks of the wanted
suffixes, split by their first bytes, are sorted on their own by their first PERIOD bytes, and
suffixes that tie for so long are ordered by the ranks of the two cover places that lie at one
and the same short distance after them: a merge sort, whose comparisons are made for all ties at
once. Only one block's keys are in memory at a time.
"""

from __future__ import annotations

import numpy as np

STEP = 8
ROOT = 6  # windows of 50 bytes are longer than what is sorted byte by byte, so ranks decide about them
PERIOD = ROOT * ROOT
BLOCK = 1 << 20

#: {0..r-1} and the multiples of r: every distance modulo r * r is a multiple of r less a number under r.
COVER = np.array(sorted({*range(ROOT), *range(0, PERIOD, ROOT)}))
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _shift_table() -> np.ndarray:
    """shift[i, j]: the least d for which i + d and j + d both lie in the cover, modulo PERIOD."""
    shift = np.zeros((PERIOD, PERIOD), np.int64)
    for d in range(PERIOD - 1, -1, -1):
        both = np.roll(_IN_COVER, -d)
        shift[np.ix_(both, both)] = d
    return shift


SHIFT = _shift_table()


def keys_at_every_place(text: np.ndarray) -> np.ndarray:
    """Big-endian number of the 8 bytes from each place on; zeros follow the text, and PERIOD places more."""
    padded = np.zeros(len(text) + PERIOD + 2 * STEP, np.uint8)
    padded[: len(text)] = text
    n = len(text) + PERIOD
    keys = np.empty(n, np.uint64)
    for o in range(STEP):
        count = len(keys[o::STEP])
        keys[o::STEP] = padded[o : o + STEP * count].view(">u8")
    return keys


def _split_ties(order: np.ndarray, group: np.ndarray, key) -> np.ndarray:
    """Sort order's runs of one group number by key(places); the new group number of each place in order."""
    first = np.concatenate([[True], group[1:] != group[:-1]])
    alone = first & np.concatenate([first[1:], [True]])
    tied = np.flatnonzero(~alone)
    if len(tied):
        k = key(order[tied])
        inner = np.lexsort((k, group[tied]))
        order[tied] = order[tied][inner]
        k, g = k[inner], group[tied]
        first[tied[1:]] = (k[1:] != k[:-1]) | (g[1:] != g[:-1]) | (tied[1:] != tied[:-1] + 1)
    return np.cumsum(first)


def _by_prefix(places: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """places in the order of their first depth bytes, and group numbers of equal ones."""
    head = keys[places]
    inner = np.argsort(head, kind="stable")
    order, head = places[inner], head[inner]
    group = np.cumsum(np.concatenate([[True], head[1:] != head[:-1]])) if len(order) else np.empty(0, np.int64)
    for d in range(STEP, depth, STEP):
        if not len(group) or group[-1] == len(group):
            break
        group = _split_ties(order, group, lambda p, d=d: keys[np.minimum(p + d, len(keys) - 1)])
    return order, group


def cover_ranks(keys: np.ndarray, n: int) -> np.ndarray:
    """Rank among the cover's suffixes at every cover place below n; 0 elsewhere and past the end.

    Prefix doubling by whole periods, which lead from cover places to cover places.
    """
    places = (np.arange(0, n, PERIOD)[:, None] + COVER).ravel()
    places = places[places < n]
    order, group = _by_prefix(places, keys, PERIOD)
    ranks = np.zeros(n + PERIOD, np.int64)
    reach = PERIOD
    while len(group) and group[-1] != len(group):
        ranks[order] = group
        # Of tied suffixes those that end come first, the shortest before the others.
        group = _split_ties(order, group, lambda p, r=reach: np.where(p + r < n, ranks[np.minimum(p + r, n)], -1 - p))
        reach *= 2
        if reach > 2 * n + PERIOD:
            break
    ranks[order] = group
    return ranks


def sorted_suffixes(text: np.ndarray, places: np.ndarray | None = None, block: int = BLOCK, keys: np.ndarray | None = None):
    """Places of text (bytes as uint8), all by default, in the order of their suffixes, block by block."""
    n = len(text)
    keys = keys_at_every_place(text) if keys is None else keys
    ranks = cover_ranks(keys, n)
    places = np.arange(n) if places is None else places
    if not len(places):
        return
    head = keys[places]
    cuts = np.quantile(head[:: max(1, len(head) // 65536)], np.linspace(0, 1, -(-len(places) // block) + 1)[1:-1], method="lower") if len(places) > block else np.empty(0, np.uint64)
    side = np.searchsorted(np.unique(cuts), head, side="right") if len(cuts) else np.zeros(len(places), np.int64)

    for s in range(int(side.max()) + 1):
        own = places[side == s] if len(cuts) else places
        order, group = _by_prefix(own, keys, PERIOD)
        yield _by_ranks(order, group, ranks, n)


def _by_ranks(order: np.ndarray, group: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
    """order with its runs of one group number sorted by the cover's ranks.

    Runs are merged bottom up: an element's place in the merged run is its own and that of a
    binary search in the run beside its own.
    """
    if not len(order):
        return order
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(order)))
    width = 1
    while width < size.max():
        many = size > width
        start, count = np.repeat(first[many], size[many]), np.repeat(size[many], size[many])
        at = np.arange(len(start)) - np.repeat(np.cumsum(size[many]) - size[many], size[many])  # in the group
        here = start + at
        run = at // width
        low = np.minimum((run ^ 1) * width, count)
        high = np.minimum(low + width, count)
        lo, hi, right = low.copy(), high.copy(), (run & 1).astype(bool)
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            other, own = order[start[active] + mid], order[here[active]]
            # The right run's elements go behind equal ones of the left run.
            less = np.where(right[active], ~_before(own, other, ranks, n), _before(other, own, ranks, n))
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        merged = start + np.minimum(run * width, low) + (at - run * width) + (lo - low)
        order[merged] = order[here]
        width *= 2
    return order


def _before(i: np.ndarray, j: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
    """Whether the suffixes from i go before those from j, both alike for a period."""
    d = SHIFT[i % PERIOD, j % PERIOD]
    a, b = i + d, j + d
    return np.where(a < n, ranks[np.minimum(a, n)], -1 - i) < np.where(b < n, ranks[np.minimum(b, n)], -1 - j)


def equal_windows(text: np.ndarray, places: np.ndarray, width: int, block: int = BLOCK) -> np.ndarray:
    """A class number for each of places: equal for equal width-byte strings. places + width must lie in text.

    Neighbours in suffix order are compared; equal strings are neighbours, also across blocks.
    """
    keys = keys_at_every_place(text)
    offsets = [*range(0, width - STEP + 1, STEP), *([width - STEP] if width % STEP and width >= STEP else [])]
    out = np.empty(len(text), np.int64)
    last, number = None, 0
    for order in sorted_suffixes(text, places, block, keys):
        if not len(order):
            continue
        line = order if last is None else np.concatenate([[last], order])
        same = np.ones(len(line) - 1, bool)
        if width < STEP:
            for o in range(width):
                same &= text[line[1:] + o] == text[line[:-1] + o]
        for o in offsets if width >= STEP else ():
            k = keys[line + o]
            same &= k[1:] == k[:-1]
        new = np.concatenate([[True], ~same]) if last is None else ~same
        classes = number + np.cumsum(new)
        out[order] = classes
        last, number = order[-1], int(classes[-1])
    return out[places]
