"""Relative Lempel-Ziv parsing of a shard: spans are factored against the spans that come before them.

The reference index of a shard holds, for every window of words, its first occurrence. A span is parsed greedily from the
left: where the window at the cursor occurs earlier, the factor is extended word by word as far as that occurrence goes on;
where it does not, one word is passed as a literal. A factor of at least a window makes all its windows duplicates. Windows that
cross a factor's end are not inside any factor; they are looked up one by one. All spans of a shard are parsed side by
side, one factor or literal each in a wave.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.text import ranges, rolling


class Index:
    """First occurrences of all windows in the spans of a shard."""

    def __init__(self, units: np.ndarray, bounds: np.ndarray, window: int):
        self.units, self.window = units, window
        room = np.diff(bounds) - window + 1
        self.starts = ranges(bounds[:-1], np.maximum(room, 0))
        self.gram = rolling(units, window)
        self.keys, first = np.unique(self.gram[self.starts], return_index=True) if len(self.starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.first = self.starts[first]

    def source(self, at: np.ndarray) -> np.ndarray:
        """An earlier start of the window at each position, or -1; the words are compared, not the hashes alone."""
        if not len(at):
            return at
        src = self.first[np.searchsorted(self.keys, self.gram[at])]
        ok = src < at
        cols = np.arange(self.window)
        ok[ok] = (self.units[src[ok][:, None] + cols] == self.units[at[ok][:, None] + cols]).all(1)
        return np.where(ok, src, -1)


def factors(units: np.ndarray, bounds: np.ndarray, window: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the greedy parse's factors of at least a window."""
    cursor, last = bounds[:-1].copy(), bounds[1:] - window
    owner_end = np.repeat(bounds[1:], np.diff(bounds))
    starts, lengths = [], []
    live = np.flatnonzero(cursor <= last)
    while len(live):
        at = cursor[live]
        src = index.source(at)
        size = np.ones(len(live), np.int64)
        hit = np.flatnonzero(src >= 0)
        size[hit] = window
        grow = hit
        while len(grow):
            a, s = at[grow] + size[grow], src[grow] + size[grow]
            ok = (a < owner_end[at[grow]]) & (s < owner_end[src[grow]])
            ok[ok] = units[a[ok]] == units[s[ok]]
            grow = grow[ok]
            size[grow] += 1
        starts.append(at[hit])
        lengths.append(size[hit])
        cursor[live] = at + size
        live = live[cursor[live] <= last[live]]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *lengths])


def shared_windows(units: np.ndarray, bounds: np.ndarray, group: np.ndarray, window: int, earlier: bool) -> np.ndarray:
    """Starts of the windows of a shard that also start earlier in it; spans come in the order of their occurrence."""
    if not earlier:
        raise ValueError("the parse finds windows that occur earlier")
    index = Index(units, bounds, window)
    at, size = factors(units, bounds, window, index)
    inside = ranges(at, size - window + 1)
    # windows that start in a factor's last words cross its end
    end = np.repeat(bounds[1:], np.diff(bounds))[at] - window if len(at) else at
    cross_from = at + size - window + 1
    cross = ranges(cross_from, np.maximum(0, np.minimum(at + size - 1, end) - cross_from + 1))
    cross = np.unique(cross)
    return np.union1d(inside, cross[index.source(cross) >= 0])
