"""Byte-level BPE from a file of ranks, with a segment tree over the byte positions of each piece.

A leaf of the tree stands for the pair that begins at that byte: its rank with the position behind it, or NONE. The root is thus the
least rank, the leftmost of equals. A merge makes two leaves new (the pair of the merged token, and that of its live left neighbour) and
takes one out (the token that was merged away); each of the three goes up the tree in log2(n) steps. Live neighbours are a
linked list over positions. Short pieces of one padded length are merged together, a row of an array each and one merge a round;
longer ones, up to whole texts without a blank, have trees in flat arrays, in n log n steps and 8 bytes a node.

Each match of the pattern is a piece. A piece that is a token takes its id at once, as the format asks. The ids of pieces are kept in a
bounded table, as natural text repeats its words. Decoding concatenates the tokens' bytes.

Cases. Null text: empty, no ids. Texts of any length are encoded whole; there are no special tokens, their strings are ordinary
text. Equal rows give equal rows, whatever their ids; an empty table gives an empty one. Extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import LATIN_PATTERN, PATTERN, small

CACHE_ENTRIES, SHORT, ROWS = 200_000, 64, 1 << 14
NONE = (1 << 62) - 1


class RankBpe:
    """Encoder and decoder of a file of base64 tokens and ranks; `pattern` cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.token = {i: token for token, i in self.ids.items()}
        self.pattern = regex.compile(pattern)
        # the faster engine for texts below U+0250, where the pattern is the one that is written out for them
        self.latin = re.compile(LATIN_PATTERN) if pattern == PATTERN else self.pattern
        self.beyond = re.compile("[\u0250-\U0010ffff]")
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        # a pair of tokens merges into the token that is their bytes side by side; its id is its rank
        self.merged = {a << 32 | b: i for token, i in self.ids.items() for k in range(1, len(token)) if (a := self.ids.get(token[:k])) is not None and (b := self.ids.get(token[k:])) is not None}
        keys = np.fromiter(self.merged, np.int64, len(self.merged))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.merged.values(), np.int64, len(keys))[order]
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the two do not merge or one of them is not there (negative)."""
        key = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_short(self, pieces: list[bytes], n: int) -> list[bytes]:
        """Ids of pieces of at most n bytes (a power of two), a tree in each row: node 1 is the root, leaf p is node n + p."""
        m, bits = len(pieces), n.bit_length()
        size = np.array([len(p) for p in pieces])
        inside = np.arange(n) < size[:, None]
        token = np.full((m, n + 1), -1, np.int64)
        token[:, :n][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        right = np.tile(np.arange(1, n + 2), (m, 1))
        left = np.tile(np.arange(-1, n), (m, 1))
        tree = np.full((m, 2 * n), NONE, np.int64)
        rank = self.pair_ranks(token[:, :n], token[:, 1:])
        tree[:, n:] = np.where(rank == NONE, NONE, rank << bits | np.arange(n))
        for level in range(n.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def put(row: np.ndarray, p: np.ndarray, value: np.ndarray) -> None:
            node = p + n
            tree[row, node] = value
            while node[0] > 1:  # all leaves are on one level
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        while True:
            row = np.flatnonzero(tree[:, 1] != NONE)
            if not len(row):
                break
            least = tree[row, 1]
            p = least & ((1 << bits) - 1)
            q = right[row, p]
            after = right[row, q]
            token[row, p] = least >> bits
            token[row, q] = -1
            right[row, p] = after
            left[row, np.minimum(after, n)] = p
            put(row, q, np.full(len(row), NONE))
            rank = self.pair_ranks(token[row, p], token[row, np.minimum(after, n)])
            put(row, p, np.where(rank == NONE, NONE, rank << bits | p))
            before = left[row, p]
            some = before >= 0
            if some.any():
                r, o = row[some], before[some]
                rank = self.pair_ranks(token[r, o], token[r, p[some]])
                put(r, o, np.where(rank == NONE, NONE, rank << bits | o))
        live = token[:, :n] >= 0
        raw, end = token[:, :n][live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [raw[x:y] for x, y in zip(np.r_[0, end[:-1]].tolist(), end.tolist(), strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length."""
        count = len(piece)
        n = 1 << max(1, (count - 1).bit_length())
        bits, low = n.bit_length(), (1 << n.bit_length()) - 1
        ids = np.r_[self.byte_ids[np.frombuffer(piece, np.uint8)], -1]
        rank = self.pair_ranks(ids[:-1], ids[1:])
        nodes = np.full(2 * n, NONE, np.int64)
        nodes[n : n + count] = np.where(rank == NONE, NONE, rank << bits | np.arange(count))
        for level in range(n.bit_length() - 2, -1, -1):
            lo = 1 << level
            nodes[lo : 2 * lo] = np.minimum(nodes[2 * lo : 4 * lo : 2], nodes[2 * lo + 1 : 4 * lo : 2])
        tree, token = array("q", nodes.tobytes()), array("q", ids.tobytes())
        left, right = array("q", range(-1, count)), array("q", range(1, count + 2))
        merged = self.merged
        del nodes, ids, rank

        def put(p: int, value: int) -> None:
            node = p + n
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                if b < a:
                    a = b
                if tree[node] == a:
                    return  # nothing changes above
                tree[node] = a
                node >>= 1

        def pair(p: int, q: int) -> int:
            r = merged.get(token[p] << 32 | token[q]) if p >= 0 and q < count else None
            return NONE if r is None else r << bits | p

        while (least := tree[1]) != NONE:
            p = least & low
            q = right[p]
            after = right[q]
            token[p] = least >> bits
            token[q] = -1
            right[p] = after
            left[min(after, count)] = p
            put(q, NONE)
            put(p, pair(p, after))
            if left[p] >= 0:
                put(left[p], pair(left[p], p))
        out = np.frombuffer(token, np.int64)[:count]
        return out[out >= 0].astype("<u4").tobytes()

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            known = self.ids.get(p)
            if known is not None:
                out[i] = known.to_bytes(4, "little")
            elif len(p) > SHORT:
                out[i] = self.merge_long(p)
            else:
                groups.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for n, members in groups.items():
            for at in range(0, len(members), ROWS):
                some = members[at : at + ROWS]
                for i, ids in zip(some, self.merge_short([pieces[i] for i in some], n), strict=True):
                    out[i] = ids
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        parts = [(self.pattern if self.beyond.search(t) else self.latin).findall(t) for t in texts]
        known = self.known
        fresh = list(set().union(*parts) - known.keys())
        known.update(zip(fresh, self.merge_all([w.encode() for w in fresh]), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in parts]
        room = len(known) <= CACHE_ENTRIES
        for w in fresh:
            if len(w) > SHORT or not room:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> RankBpe:
    return RankBpe(path, pattern)


def _plain(docs: DataFrame, id_col: str, column: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").alias("x"))


def encode_ranked(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids: the encoded text as little-endian 32-bit integers)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary, pattern)
        for b in small(batches):
            ids = model.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _plain(docs, id_col, text_col).mapInArrow(encode, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_ranked(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) from the rows of `encode_ranked`."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return _plain(encoded, id_col, ids_col).mapInArrow(decode, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def ranked_round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, n_tokens, digests of the ids and of the decoded bytes."""

    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary, pattern)
        for b in small(batches):
            ids = model.encode_batch([t or "" for t in b.column(1).to_pylist()])
            digests = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(model.decode(x)).hexdigest() for x in ids]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(d, pa.string()) for d in digests)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _plain(docs, id_col, text_col).mapInArrow(trip, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
