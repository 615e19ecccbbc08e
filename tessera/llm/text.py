"""Vectorised text handling shared by the corpus operators.

Arrow batches of (id, text) are cut into chunks of bounded bytes; words, rolling hashes and content-chosen anchors are
then computed with numpy over the UTF-8 bytes of a whole chunk at once. Nothing here looks at a prefix: a chunk holds
whole documents, so one document larger than the bound makes a chunk of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
LONG_WORD = 32  # bytes; longer words are hashed by a digest
_U = np.uint64
#: Odd multipliers of the rolling hashes and of the finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
WORD = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> _U(30))
    h *= _U(MIX_1)
    h ^= h >> _U(27)
    h *= _U(MIX_2)
    h ^= h >> _U(31)
    return h


#: A value of 64 bits for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(BASE))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base & WORD, dtype=_U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        _powers[base] = have
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)

#: Byte classes. Blanks: the six ASCII white-space characters.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 9, 10, 11, 12, 13]] = True
NOT_BLANK = ~BLANKS
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


class Chunk:
    """Whole documents: row numbers in their batch, their bytes, and n+1 offsets from 0."""

    def __init__(self, batch: pa.RecordBatch, first: int, data: np.ndarray, off: np.ndarray):
        self.batch, self.first, self.data, self.off = batch, first, data, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name).slice(self.first, len(self))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def give_back() -> None:
    """Return free memory to the system at the end of a partition: Spark keeps its Python workers, and what they have freed would
    stay with them beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str | int = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches into chunks of at most `limit` bytes of text, of one document at least."""
    for batch in batches:
        raw, off = text_buffers(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(n, max(at + 1, to))
            yield Chunk(batch, at, raw[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to
    give_back()


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of bytes of a class that stay in one document, and where each document's
    words begin in that list (n+1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    is_word = inside[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] = is_word[heads]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    ends[tails] = is_word[tails]
    # a word that ends where its document ends and one that begins there are two words
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[starts:ends], one for each span, in time linear in the values."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, _U)
    total = np.zeros(n + 1, _U)
    np.cumsum(values * powers(BASE, n), out=total[1:])
    h = total[ends] - total[starts]
    h *= powers(INVERSE, n + 1)[starts]
    h += (ends - starts).astype(_U) * _U(MIX_2)
    return mix(h)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of each word, of its folded bytes where `fold` is set.

    Sums modulo 2**64 cancel for long words of a regular build (one that follows the Thue-Morse sequence, and its
    complement), whatever the base. So words of more than LONG_WORD bytes, which are few, get a cryptographic digest."""
    h = span_hashes((BYTE_VALUES[FOLD] if fold else BYTE_VALUES)[data], starts, ends)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    for i, x, y in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        word = FOLD[data[x:y]] if fold else data[x:y]
        h[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    return h


def rolling(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k units; entry i is of units[i:i+k]."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    done, length, block, size, left = None, 0, units, 1, k
    while True:
        if left & 1:
            if done is None:
                done = block
            else:
                m = len(block) - length
                done = done[:m] * _U(pow(BASE, size, 1 << 64)) + block[length : length + m]
            length += size
        left >>= 1
        if not left:
            return mix(done[:n].copy())
        block = block[:-size] * _U(pow(BASE, size, 1 << 64)) + block[size:]
        size *= 2


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` entries, by doubling."""
    size, m = 1, key
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    return m


class Anchors:
    """Content-chosen anchors of all windows of a chunk.

    Every window of `window` units picks the k-gram in it with the least hash, the leftmost of equals. Equal windows
    pick equal grams at equal offsets, so windows can only be equal if they share an anchor. Arrays, one entry for each
    maximal run of neighbouring windows with one anchor: gram (its hash), at (its unit), first and last (window
    starts), and span (hash of all units of the run's windows and of the anchor's offset in them).
    """

    def __init__(self, units: np.ndarray, bounds: np.ndarray, window: int, k: int):
        n = len(units)
        self.gram = self.span = np.zeros(0, _U)
        self.at = self.first = self.last = np.zeros(0, np.int64)
        if n < window:
            return
        gram = rolling(units, k)
        key = (gram & _U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=_U)
        least = sliding_min(key, window - k + 1)
        owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        starts = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
        if not len(starts):
            return
        at = (least[starts] & _U(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.at, self.first = at[new], starts[new]
        self.last = starts[np.r_[new[1:], len(starts)] - 1]
        self.gram = gram[self.at]
        self.span = mix(span_hashes(units, self.first, self.last + window) + (self.at - self.first).astype(_U))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each of the runs, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions below n in any of the spans [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
