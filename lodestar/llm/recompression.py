"""Locally consistent parsing of word sequences by recompression.

Words are symbols.  A first round names runs of one word, each later round names
pairs: every symbol falls on the left or right side by a bit of its name, and a
left symbol followed by a right one becomes one new symbol.  Names are 64-bit
hashes of what they stand for, so that the same run or pair gets the same name
in every text and on every executor.

A symbol exists because of words within a range (its *reach*): those under it
and those that kept its edges from merging.  Wherever that range of words stands
again, the symbol stands again.  So a window of words determines the symbols
whose reach lies within it, and from them its *anchor*: the longest, then the
one of the smallest name, then the leftmost.  Equal windows have equal anchors.
"""

from __future__ import annotations

import numpy as np

from lodestar.llm.textbytes import mix

PAIR_ROUNDS = 7
_OUT = 1 << 40  # a reach beyond the text


def _salted(names: np.ndarray, salt: int) -> np.ndarray:
    return mix(names ^ np.uint64((salt * 0xD6E8FEB86659FD93) & (2**64 - 1)))


def symbols(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The named runs and pairs whose reach is at most ``width`` words.

    Returns name, start, length, reach start and reach end of each; positions
    count words over all texts.  ``first`` says where each text's words begin.
    """
    n = len(hashes)
    found: list[tuple[np.ndarray, ...]] = []
    if not n:
        return tuple(np.empty(0, t) for t in (np.uint64, *[np.int64] * 4))
    opens = np.zeros(n + 1, dtype=bool)
    opens[first] = True
    start = np.arange(n)

    # runs: a word alone, or all equal words in a row
    new = opens[:-1].copy()
    new[1:] |= hashes[1:] != hashes[:-1]
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, n))
    name = hashes[head]
    longer = length > 1
    name = np.where(longer, mix(_salted(name, 1) + length.astype(np.uint64)), name)
    start, opened = head, opens[head]
    closed = np.append(opened[1:], True)
    # that a run is no longer hangs on one word at either side
    reach_lo = np.where(opened, start - _OUT, start - 1)
    reach_hi = np.where(closed, start + length + _OUT, start + length + 1)

    def keep(which: np.ndarray) -> None:
        which &= reach_hi - reach_lo <= width
        found.append((name[which], start[which], length[which], reach_lo[which], reach_hi[which]))

    keep(longer.copy())
    for turn in range(PAIR_ROUNDS):
        bits = _salted(name, 100 + turn)
        right = (bits >> np.uint64(40)) & np.uint64(1) == 1
        pairs = np.zeros(len(name), dtype=bool)  # of the left symbol
        pairs[:-1] = ~right[:-1] & right[1:] & ~opened[1:]
        taken = np.zeros(len(name), dtype=bool)
        taken[1:] = pairs[:-1]
        # what stays single hangs on the neighbour it might have merged with
        before_lo = np.concatenate([[-_OUT], reach_lo[:-1]])
        after_hi = np.concatenate([reach_hi[1:], [n + _OUT]])
        single_lo = np.where(right, np.where(opened, start - _OUT, np.minimum(before_lo, reach_lo)), reach_lo)
        single_hi = np.where(~right, np.where(closed, start + length + _OUT, np.maximum(after_hi, reach_hi)), reach_hi)
        next_of = np.concatenate([np.arange(1, len(name)), [0]])
        stay = np.flatnonzero(~taken)
        two = pairs[stay]
        other = next_of[stay]
        merged = np.where(two, mix(_salted(name[stay], 2) + _salted(name[other], 3)), name[stay])
        reach_lo, reach_hi = (
            np.where(two, np.minimum(reach_lo[stay], reach_lo[other]), single_lo[stay]),
            np.where(two, np.maximum(reach_hi[other], reach_hi[stay]), single_hi[stay]),
        )
        length = length[stay] + np.where(two, length[other], 0)
        closed = np.where(two, closed[other], closed[stay])
        start, opened, name = start[stay], opened[stay], merged
        keep(two.copy())
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchors(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``width`` words, in order: its start, its anchor's
    name, and the place of that anchor."""
    counts = np.diff(first)
    per = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), per)
    windows = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + first[owner]
    best = np.full(len(hashes) + 1, -1, dtype=np.int64)
    name, start, length, lo, hi = symbols(hashes, first, width)
    # in the order in which they may be overridden: shorter, larger name, further right
    order = np.lexsort((-start, ~name, length))
    begins, spans = hi[order] - width, lo[order] - hi[order] + width + 1
    short = begins < 0
    spans[short] += begins[short]
    begins[short] = 0
    spans = np.maximum(spans, 0)
    reached = np.repeat(begins - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    inside = reached < len(best)
    best[reached[inside]] = np.repeat(order, spans)[inside]
    chosen = best[windows]
    lone = np.flatnonzero(chosen < 0)
    names, places = np.empty(len(windows), np.uint64), np.empty(len(windows), np.int64)
    has = chosen >= 0
    names[has], places[has] = name[chosen[has]], start[chosen[has]]
    if len(lone):  # no named symbol within: the smallest word
        at = windows[lone]
        least, where = hashes[at].copy(), at.copy()
        for step in range(1, width):
            new = hashes[at + step]
            smaller = new < least
            least[smaller], where[smaller] = new[smaller], at[smaller] + step
        names[lone], places[lone] = least, where
    return windows, names, places
