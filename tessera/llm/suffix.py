"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy; repeated windows of a shard.

Suffixes are classified as larger or smaller than their right neighbour. The leftmost-smaller substrings are sorted by one
round of induction and named; if names repeat, the string of names is sorted recursively. From the sorted
leftmost-smaller suffixes the whole array is induced: over a small alphabet bucket by bucket in waves (linear work), over a large
one (the recursion's names) by ranks that double along each run of one type.

Permuted common prefixes: a position is reducible if it and its predecessor in the array follow equal letters; only
irreducible ones are compared letter by letter (n log n letters in all), the others follow by subtraction.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024
STEP = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers; the last one must be the only 0."""
    text = np.asarray(text, np.int64)
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    rise = np.diff(text)
    at = np.where(rise != 0, np.arange(n - 1), n)
    smaller = np.empty(n, bool)
    smaller[-1] = True
    smaller[:-1] = rise[np.minimum.accumulate(at[::-1])[::-1]] > 0
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = induce_by_buckets if int(text.max()) < SMALL_ALPHABET else induce_by_ranks
    if len(lms) == 1:
        return induce(text, smaller, lms)
    sa = induce(text, smaller, lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    size = np.r_[np.diff(lms) + 1, 1][number[order]]
    differs = np.ones(len(order), bool)
    differs[1:] = size[1:] != size[:-1]
    left = np.flatnonzero(~differs)
    padded = np.r_[text, np.zeros(STEP, np.int64)]
    done = 0
    while len(left):
        width = np.minimum(STEP, size[left] - done)
        cols = np.arange(STEP)
        same = (padded[order[left][:, None] + done + cols] == padded[order[left - 1][:, None] + done + cols]) | (cols >= width[:, None])
        same = same.all(1)
        differs[left[~same]] = True
        done += STEP
        left = left[same & (size[left] > done)]
    name = np.cumsum(differs) - 1
    if name[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[number[order]] = name
        order = lms[suffix_array(reduced)]
    return induce(text, smaller, order)


def _deal(queues: list, values: np.ndarray, letters: np.ndarray) -> None:
    """Append `values` to the queues of their letters, keeping their order."""
    if not len(values):
        return
    order = np.argsort(letters, kind="stable")
    letters, values = letters[order], values[order]
    head = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]])
    for c, x, y in zip(letters[head].tolist(), head.tolist(), [*head[1:].tolist(), len(values)], strict=True):
        queues[c].append(values[x:y])


def induce_by_buckets(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from sorted leftmost-smaller suffixes: one scan up for the larger, one down for the smaller ones."""
    k = int(text.max()) + 1
    letter = text.astype(np.uint16)
    none = np.zeros(0, np.int64)
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    known = [none] * k
    own = letter[lms]
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    for c, x, y in zip(own[head].tolist(), head.tolist(), [*head[1:].tolist(), len(lms)], strict=True):
        known[c] = lms[x:y]
    up = [none] * k

    def before(some: np.ndarray, kind: bool) -> np.ndarray:
        p = some[some > 0] - 1
        return p[smaller[p] == kind]

    for c in range(k):
        waves, wave = [], np.concatenate(larger[c]) if larger[c] else none
        while len(wave):
            waves.append(wave)
            p = before(wave, False)
            here = letter[p] == c
            _deal(larger, p[~here], letter[p[~here]])
            wave = p[here]
        up[c] = np.concatenate(waves) if waves else none
        p = before(known[c], False)
        _deal(larger, p, letter[p])
    lesser: list[list[np.ndarray]] = [[] for _ in range(k)]
    out = [none] * k
    for c in range(k - 1, -1, -1):
        waves, wave = [], np.concatenate(lesser[c]) if lesser[c] else none
        if c == 0:
            wave = np.array([len(text) - 1])
        while len(wave):
            waves.append(wave)
            p = before(wave, True)
            here = letter[p] == c
            _deal(lesser, p[~here], letter[p[~here]])
            wave = p[here]
        down = np.concatenate(waves)[::-1] if waves else none
        p = before(up[c][::-1], True)
        _deal(lesser, p, letter[p])
        out[c] = np.concatenate([up[c], down])
    return np.concatenate(out)


def induce_by_ranks(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same array over a large alphabet. A suffix of a type is ordered by its letters up to the next suffix of known
    rank and by that rank; ranks over 1, 2, 4, ... steps of the run are doubled until all differ."""
    n = len(text)
    kind = text * 2 + smaller

    def resolve(nodes: np.ndarray, fixed: np.ndarray, order_of_fixed: np.ndarray) -> np.ndarray:
        """Ranks of `nodes` (a mask of positions); the order of `fixed` ones among themselves is known."""
        at = np.flatnonzero(nodes)
        rank = np.zeros(n, np.int64)
        tie = np.zeros(n, np.int64)
        tie[order_of_fixed] = np.arange(len(order_of_fixed))
        first = kind[at] * n + np.where(fixed[at], tie[at], 0)
        live = at[np.argsort(first)]
        place, old, new = np.arange(len(at)), np.zeros(len(at), np.int64), np.sort(first)
        jump = np.where(fixed, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
        while True:
            # a rank is the place of its group's first member; only members of groups are sorted again
            group = np.r_[True, old[1:] != old[:-1]]
            head = group | np.r_[True, new[1:] != new[:-1]]
            rank[live] = place[np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))]
            alone = head & np.r_[head[1:], True]
            if alone.all():
                return rank
            live, place = live[~alone], place[~alone]
            old, new = rank[live], rank[jump[live]]
            order = np.argsort(old * n + new)
            live, old, new = live[order], old[order], new[order]
            jump[live] = jump[jump[live]]

    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rank = resolve(~smaller | is_lms, is_lms, lms)
    larger = np.flatnonzero(~smaller)
    larger = larger[np.argsort(rank[larger])]
    rank = resolve(np.ones(n, bool), ~smaller, larger)
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: its predecessor in the array (-1: none) and the length of their common prefix."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    i = np.arange(n)
    irreducible = (phi <= 0) | (i == 0)
    rest = np.flatnonzero(~irreducible)
    irreducible[rest] = text[rest - 1] != text[phi[rest] - 1]
    left = np.flatnonzero(irreducible & (phi >= 0))
    padded = np.r_[text, np.zeros(STEP, text.dtype)]
    done = 0
    cols = np.arange(STEP)
    while len(left):
        same = padded[left[:, None] + (done + cols)] == padded[phi[left][:, None] + (done + cols)]
        plcp[left] += np.where(same.all(1), STEP, same.argmin(1))
        left = left[same.all(1)]
        done += STEP
    last = np.maximum.accumulate(np.where(irreducible, i, 0))
    return phi, plcp[last] - (i - last)


def shared_windows(units: np.ndarray, bounds: np.ndarray, group: np.ndarray, window: int, earlier: bool) -> np.ndarray:
    """Starts of the windows of a shard (spans of bytes) that also start elsewhere in it."""
    if earlier:
        raise ValueError("suffix arrays find windows that occur anywhere else")
    n = len(bounds) - 1
    size = np.diff(bounds)
    place = np.arange(len(units)) + np.repeat(np.arange(n), size)
    text = np.ones(len(units) + n + 1, np.int64)
    text[place] = units.astype(np.int64) + 2
    text[-1] = 0
    sa = suffix_array(text)
    phi, plcp = common_prefixes(text.astype(np.uint16), sa)
    room = np.zeros(len(text), np.int64)
    room[place] = np.repeat(bounds[1:], size) - np.arange(len(units))
    hit = np.flatnonzero((plcp >= window) & (room >= window))
    back = np.full(len(text), -1, np.int64)
    back[place] = np.arange(len(units))
    return np.unique(back[np.concatenate([hit, phi[hit]])])
