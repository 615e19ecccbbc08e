"""Alignments and similarities of two sequences in linear or near-linear space.

Common subsequences of two strings and edit distances are bit-parallel: a column of the table is one whole number with a bit for each item of
the shorter sequence, so a step over the other sequence is a handful of operations on it. Those with all parts of a long string come from
one table, many pairs at a time. Edit scripts keep the cells near the diagonal only, as many as the distance asks for, a row of diagonals
at a time.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def places(items: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each distinct item a number with the bits of its places."""
    bits: dict[Hashable, int] = {}
    for i, v in enumerate(items):
        bits[v] = bits.get(v, 0) | 1 << i
    return bits


def common_length(bits: dict[Hashable, int], n: int, other: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence of the n items behind `bits` with another sequence."""
    full = (1 << n) - 1
    free = full
    for v in other:
        hit = free & bits.get(v, 0)
        if hit:
            free = (free + hit | free - hit) & full
    return n - free.bit_count()


def similarity(a: str, b: str) -> float:
    """100 x twice the longest common subsequence over both lengths; 0 for two empty strings."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return 200 * common_length(places(short), len(short), long) / (len(a) + len(b)) if short else 0.0


LANES, TOGETHER = 512, 16  # parts of texts that are compared side by side, and lengths of the shorter text that such a part has
WIDTH, STEP = 1 << 15, 64  # characters of shorter texts side by side, and by how much their lengths may differ


def comb(shorts: list[str], longs: list[str]) -> np.ndarray:
    """For each pair a row with a number for each character of the longer text, from which all its parts' common lengths with the shorter one follow.

    The table of a common subsequence is crossed by strands that enter at its left and top edge and leave at its right and bottom one; two
    meet in each cell, and they turn away from each other where characters are equal or where they have crossed before. The number at a
    place is that of the top place whose strand leaves below it, or negative. Characters i to j of the longer text have j - i in common with the
    shorter one, less the strands that enter and leave between i and j. A step takes a diagonal of the tables of all pairs."""
    lanes, m, n = len(shorts), max(map(len, shorts)), max(map(len, longs))
    points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    known = np.unique(points("".join(shorts)))
    base = 1 << int(len(known) + 1).bit_length()  # above every difference of two codes, below every strand
    kind = np.uint16 if base + m + n < 0xFFFF else np.uint32
    codes = np.zeros(0x110000, kind)
    codes[known] = np.arange(2, len(known) + 2)
    a, b = np.ones((lanes, m), kind), np.zeros((lanes, n), kind)  # what is beyond a text equals nothing
    for i, (x, y) in enumerate(zip(shorts, longs, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = codes[points(x)], codes[points(y)]
    a, b = a.T.ravel(), b[:, ::-1].T.ravel()
    left = np.repeat(np.arange(base + m - 1, base - 1, -1, dtype=kind), lanes)
    top = np.repeat(np.arange(base + m + n - 1, base + m - 1, -1, dtype=kind), lanes)
    turned, flag, one = left.copy(), np.empty_like(left), kind(1)
    for t in range(n + m - 1):
        low, high, shift = max(0, t - n + 1) * lanes, min(m, t + 1) * lanes, (n - 1 - t) * lanes
        f, x, y, z = flag[low:high], left[low:high], top[shift + low : shift + high], turned[low:high]
        # the greatest number where characters are equal, else the left strand; the lower one goes on to the right
        np.bitwise_xor(a[low:high], b[shift + low : shift + high], out=f)
        np.subtract(f, one, out=f)
        np.maximum(f, x, out=f)
        np.minimum(f, y, out=z)
        np.add(y, x, out=y)
        np.subtract(y, z, out=y)
        left, turned = turned, left
    return np.ascontiguousarray(top.reshape(n, lanes)[::-1].T).astype(np.int32) - (base + m)


def _best_part(came: np.ndarray, m: int, begins: bool, ends: bool) -> float:
    """Best similarity of a text of m characters with a window as long in the one that a row of `comb` is about, or with a shorter one at its
    begin or end, where that counts."""
    n = len(came)
    end = np.flatnonzero(came >= 0)
    start = came[end]
    # a strand is lost to the windows that hold both its ends: from the one that begins m - 1 before its end to the one at its start
    short = end - start < m
    lost = np.bincount(np.maximum(end[short] - (m - 1), 0), minlength=n + 1) - np.bincount(start[short] + 1, minlength=n + 1)
    best = 100 * (m - int(lost[: n - m + 1].cumsum().min())) / m
    size = np.arange(1, m + 1)
    for counts, places in ((begins, end), (ends, n - 1 - start)):
        if counts:
            inside = np.bincount(places[places < m], minlength=m).cumsum()
            best = max(best, float((200 * (size - inside) / (m + size)).max()))
    return best


def partial_ratios(pairs: Sequence[tuple[str, str]], least: Sequence[float]) -> list[float]:
    """Best similarity (0 to 100) of the shorter string of each pair with any part of the longer one that is as long, or that is cut short
    by one of its ends, but `least` at least. Exact: every part counts. Long strings are cut into parts that share windows' lengths."""
    best, parts = list(least), []
    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if not a or best[i] >= 100:
            continue
        if a in b:
            best[i] = 100.0
            continue
        for x, y in ((a, b), (b, a))[: 1 + (len(a) == len(b))]:
            m, step = len(x), TOGETHER * len(x)
            parts += [(m // STEP, min(step + m - 1, len(y) - k), i, x, y, k) for k in range(0, len(y) - m + 1, step)]
    parts.sort(key=lambda p: p[:2])
    while parts:
        # parts of about the same size, from the largest on
        width, n = parts[-1][:2]
        count = 1
        while count < min(len(parts), LANES, WIDTH // (STEP * width + STEP)) and parts[-1 - count][0] == width and 4 * parts[-1 - count][1] + 256 >= 3 * n:
            count += 1
        some = parts[-count:]
        del parts[-count:]
        rows = comb([x for *_, x, _, _ in some], [y[k : k + n] for _, n, _, _, y, k in some])
        for row, (_, n, i, x, y, k) in zip(rows, some, strict=True):
            best[i] = max(best[i], _best_part(row[:n], len(x), k == 0, k + n == len(y)))
    return best


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The same for one pair."""
    return partial_ratios([(a, b)], [least])[0]


def token_set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Similarity (0 to 100) of two sets of words, but `least` at least: the sorted common words against each side's sorted words, and the two
    sides against each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return least
    if x <= y or y <= x:
        return 100.0
    length = lambda words: sum(map(len, words)) + len(words) - 1
    both, one, two = x & y, x - y, y - x
    common = length(both) if both else 0
    blank = bool(both)
    sides = [common + blank + length(d) for d in (one, two)]
    best = max(100 - 100 * (blank + length(d)) / (common + side) for d, side in zip((one, two), sides, strict=True)) if both else 0.0
    best = max(best, least)
    # the two differ at least by their lengths
    if 100 - 100 * abs(length(one) - length(two)) / sum(sides) > best:
        short, long = sorted((" ".join(sorted(d)) for d in (one, two)), key=len)
        apart = len(short) + len(long) - 2 * common_length(places(short), len(short), long)
        best = max(best, 100 - 100 * apart / sum(sides))
    return best


def groundings(quotes: Sequence[str], bodies: Sequence[str]) -> list[float]:
    """The better of the two ratios of each quote over its whole body, one decimal; 0 where one side is empty."""
    pairs = list(zip(quotes, bodies, strict=True))
    parts = partial_ratios(pairs, [0.0] * len(pairs))
    return [round(v if v >= 100 else token_set_ratio(q, b, v), 1) for (q, b), v in zip(pairs, parts, strict=True)]


def grounding_score(quote: Column, body: Column) -> Column:
    """`groundings` as a column."""

    @F.pandas_udf("double")
    def score(q: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(groundings(q.fillna(""), b.fillna("")), dtype="f8")

    return score(quote, body)


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Least number of insertions, deletions and replacements. Bits tell where a column of the table rises or falls downwards."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    bits, full, last = places(a), (1 << m) - 1, 1 << m - 1
    rise, fall, cost = full, 0, m
    for v in b:
        eq = bits.get(v, 0)
        diagonal = ((eq & rise) + rise ^ rise | eq | fall) & full
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal
        cost += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, down << 1 & full
        rise, fall = (down | ~(diagonal | up)) & full, up & diagonal
    return cost


class _Band:
    """Edit costs of prefixes (i, j) with |j - i| <= reach, row by row; entry k of row i is of j = i + k - reach."""

    def __init__(self, x: np.ndarray, y: np.ndarray, reach: int):
        self.x, self.n, self.m, self.reach, self.width = x, len(x), len(y), reach, 2 * reach + 1
        self.far = self.n + self.m + 1
        self.at = np.arange(self.width, dtype=np.int32)
        side = np.full(reach + 1, -1, np.int32)
        # items and walls before place 0 and behind place m, so that every row is a plain slice
        self.y = np.r_[side, y.astype(np.int32), np.full(self.n + reach + 1, -1, np.int32)]
        self.wall = np.r_[np.full(reach, self.far, np.int32), np.zeros(self.m + 1, np.int32), np.full(self.n + reach + 1, self.far, np.int32)]

    def first(self) -> np.ndarray:
        return np.where(self.wall[: self.width] > 0, self.far, self.at - self.reach).astype(np.int32)

    def after(self, row: np.ndarray, i: int) -> np.ndarray:
        """Row i from row i - 1."""
        cost = row + (self.y[i : i + self.width] != self.x[i - 1])
        np.minimum(cost[:-1], row[1:] + 1, out=cost[:-1])
        wall = self.wall[i : i + self.width]
        np.maximum(cost, wall, out=cost)
        cost -= self.at
        np.minimum.accumulate(cost, out=cost)
        cost += self.at
        np.maximum(cost, wall, out=cost)
        if i <= self.reach:
            cost[self.reach - i] = i
            np.minimum(cost[self.reach - i :], i + self.at[: self.width - self.reach + i], out=cost[self.reach - i :])
            np.maximum(cost, wall, out=cost)
        return cost.astype(np.int32, copy=False)


def edit_match(a: Sequence[Hashable], b: Sequence[Hashable], keep_replaced: bool = False) -> tuple[list[int], list[int]]:
    """Places in two sequences that an optimal edit script leaves matched (or also replaced); of equally good scripts the one that,
    read from the end, replaces or matches first, then deletes, then inserts.

    No script of cost d leaves the d diagonals beside the middle one, so costs are computed in a band that doubles until it holds
    the distance. Only every sqrt(n)-th row is kept; the rows between two of them are computed again on the way back."""
    codes: dict[Hashable, int] = {}
    x, y = (np.array([codes.setdefault(v, len(codes)) for v in s], np.int32) for s in (a, b))
    n, m = len(x), len(y)
    if not n or not m:
        return [], []
    step = max(1, math.isqrt(n))
    distance, reach = edit_distance(x.tolist(), y.tolist()) if min(n, m) <= 4096 else None, abs(n - m) + 64
    while True:
        reach = min(max(n, m), reach if distance is None else max(1, distance))
        band = _Band(x, y, reach)
        row = band.first()
        kept = [row]
        for i in range(1, n + 1):
            row = band.after(row, i)
            if i % step == 0:
                kept.append(row)
        if row[m - n + reach] <= reach or reach == max(n, m):
            break
        reach *= 2
    p, q, i, j = [], [], n, m
    rows: list[np.ndarray] = []
    base = n + 1
    while i and j:
        if i - 1 < base:
            base = (i - 1) // step * step
            rows = [kept[base // step]]
            for r in range(base + 1, min(n, base + step) + 1):
                rows.append(band.after(rows[-1], r))
        k = j - i + reach
        here, above = rows[i - base], rows[i - 1 - base]
        same = x[i - 1] == y[j - 1]
        if here[k] == above[k] + (not same):
            if same or keep_replaced:
                p.append(i - 1)
                q.append(j - 1)
            i, j = i - 1, j - 1
        elif k + 1 < band.width and here[k] == above[k + 1] + 1:
            i -= 1
        else:
            j -= 1
    return p[::-1], q[::-1]


def word_error_rate(truth: Column, got: Column) -> Column:
    """Edit distance over words, by the number of words in the truth, 1 at least."""

    @F.pandas_udf("double")
    def rate(t: pd.Series, g: pd.Series) -> pd.Series:
        pairs = (((x or "").split(), (y or "").split()) for x, y in zip(t, g, strict=True))
        return pd.Series([edit_distance(x, y) / max(1, len(x)) for x, y in pairs], dtype="f8")

    return rate(truth, got)
