"""Best offsets between token sequences, for many pairs of sequences at once."""

from __future__ import annotations

import math

import numpy as np

#: Times are whole numbers of this share of a second, as every double from 2^30 s on (2004) is one.
TICKS = 2.0**22
#: Pairs of tokens that are compared at once.
AT_ONCE = 2_000_000


def merged(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Open intervals of groups (whole numbers from 0 on), those of a group that overlap as one; in the order of (group, low)."""
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    if not len(group):
        return group, low, high
    new = np.ones(len(group), bool)
    width = int(high.max() - low.min()) + 1
    if int(group[-1] + 1) * width < 2**62:
        top = np.maximum.accumulate(group * width + (high - low.min()))
        new[1:] = (group[1:] != group[:-1]) | (low[1:] - low.min() + group[1:] * width >= top[:-1])
        last = np.r_[np.flatnonzero(new)[1:], len(group)] - 1
        return group[new], low[new], top[last] % width + low.min()
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
    parts = [merged(np.zeros(b - a, np.int64), low[a:b], high[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.concatenate([np.full(len(p[0]), group[a]) for p, a in zip(parts, cuts, strict=False)]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2))


class Side:
    """Tokens (group, time, frequency) in the order of their groups and times; times in ticks."""

    def __init__(self, group: np.ndarray, t: np.ndarray, freq: np.ndarray):
        t = np.rint(np.asarray(t, "f8") * TICKS).astype(np.int64)
        self.order = np.lexsort((t, group))
        self.group, self.t, self.freq = group[self.order], t[self.order], np.asarray(freq, "f8")[self.order]


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): the places from first to before end of each row."""
    n = np.maximum(end - first, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def in_range(t, freq, low, high, u, g, uc, token, bins, since: int, until: int, at_once: int) -> tuple[int, int] | None:
    """(score, offset) of one pair of long sequences, of the offsets from `since` to before `until`; halves of the range where it holds too many."""
    a, b = np.searchsorted(t, since + u), np.searchsorted(t, until + u)
    ia, ib = np.searchsorted(high, since + uc, "right"), np.searchsorted(low, until + uc)
    pairs = int((b - a).sum())
    if not pairs:
        return None
    # intervals that reach into the range are at most the pairs and two a token more
    if pairs > at_once and until - since > 1:
        middle = (since + until) // 2
        found = [in_range(t, freq, low, high, u, g, uc, token, bins, x, y, at_once) for x, y in ((since, middle), (middle, until))]
        return max((f for f in found if f), key=lambda f: (f[0], -f[1]), default=None)
    row, place = ranges(a, b)
    at = np.sort((t[place] - u[row])[np.abs(freq[place] - g[row]) <= bins])
    if not len(at):
        return None
    row, place = ranges(ia, ib)
    starts, ends = low[place] - uc[row], high[place] - uc[row]
    if token is not None:
        _, starts, ends = merged(token[row], starts, ends)
    score = np.searchsorted(np.sort(starts), at) - np.searchsorted(np.sort(ends), at, "right")
    best = int(score.argmax())
    return int(score[best]), int(at[best])


def best(songs: Side, samples: Side, token: np.ndarray, bins: float, tolerance: float, at_once: int = AT_ONCE) -> tuple[np.ndarray, ...]:
    """(song, sample, score, offset) of all pairs with an offset: groups of the two sides as they are numbered, offsets in seconds. `token`
    numbers the samples' tokens, in the order in which they came, from 0 on; less than 0 for those that never count.

    A token counts at an offset where the song's times, widened by the tolerance and moved by the token's time, hold it. So the score of an
    offset is the number of such intervals that begin before it, less those that end by it: both are sorted, for a token's
    intervals do not overlap."""
    reach, token = math.ceil(tolerance * TICKS), token[samples.order]
    ig, low, high = merged(songs.group, songs.t - reach, songs.t + reach)
    names, first = np.unique(songs.group, return_index=True)
    ends, ilow, iend = np.r_[first[1:], len(songs.group)], np.searchsorted(ig, names), np.searchsorted(ig, names, "right")
    out: list = []
    heads, at = np.unique(samples.group, return_index=True)
    for sample, a, b in zip(heads, at, np.r_[at[1:], len(samples.group)], strict=False):
        u, g, tok = samples.t[a:b], samples.freq[a:b], token[a:b]
        # the times that count, each once; names are needed where one has several times
        pairs = np.unique(np.stack([tok[tok >= 0], u[tok >= 0]]), axis=1)
        tok, uc = (pairs[0], pairs[1]) if len(np.unique(pairs[0])) < pairs.shape[1] else (None, pairs[1])
        k = 0
        while k < len(names):
            most = max(1, at_once // len(u))
            n = max(1, int(np.searchsorted(ends, first[k] + most, "right")) - k)
            i, j = first[k], ends[k + n - 1]
            least = int(songs.t[i:j].min() - u.max()) - reach
            width = int(songs.t[i:j].max() - u.min()) + reach - least + 1
            if tok is not None or (j - i) * len(u) > at_once or width * n >= 2**62:
                i, j = first[k], ends[k]
                x, y = ilow[k], iend[k]
                found = in_range(songs.t[i:j], songs.freq[i:j], low[x:y], high[x:y], u, g, uc, tok, bins, int(songs.t[i] - u.max()), int(songs.t[j - 1] - u.min()) + 1, at_once)
                if found:
                    out.append((names[k : k + 1], np.full(1, sample), np.full(1, found[0]), np.full(1, found[1])))
                k += 1
                continue
            move = np.arange(n) * width - least
            d = (songs.t[i:j] + np.repeat(move, ends[k : k + n] - first[k : k + n]))[:, None] - u
            c = np.sort(d[np.abs(songs.freq[i:j, None] - g) <= bins])
            if len(c):
                x, y = ilow[k], iend[k + n - 1]
                shift = np.repeat(move, iend[k : k + n] - ilow[k : k + n])
                score = np.searchsorted(np.sort(((low[x:y] + shift)[:, None] - uc).ravel()), c) - np.searchsorted(np.sort(((high[x:y] + shift)[:, None] - uc).ravel()), c, "right")
                song = c // width
                cuts = np.flatnonzero(np.r_[True, song[1:] != song[:-1]])
                # the best score, of equal ones the first
                top = np.maximum.reduceat(score * (len(c) + 1) + len(c) - np.arange(len(c)), cuts)
                place = len(c) - top % (len(c) + 1)
                out.append((names[k + song[cuts]], np.full(len(cuts), sample), top // (len(c) + 1), c[place] % width + least))
            k += n
    song, sample, score, offset = (np.concatenate([o[m] for o in out]) if out else np.empty(0, np.int64) for m in range(4))
    return song, sample, score, offset / TICKS
