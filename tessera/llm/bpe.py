"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never lie inside a merged token, so a cut between
the two is certain. Pre-tokens are split at those cuts, the fragments are merged each by itself and their ids
concatenated. The fragments' ids are kept in a bounded table, as natural text repeats its words.

Cases. Null text: empty, no ids. Texts of any length are encoded whole. The string of an added token in a text gives that
token's id, as the tokenizers library does by default. Equal rows give equal rows; an empty table gives an empty one.
Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import chunks

CACHE_ENTRIES = 200_000
NO_RANK = 1 << 60
BATCH_CHARS = 1 << 20
#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts whose characters all lie below U+0250, in the faster engine; fixed values: the letters and
#: numbers there, and its blanks. Other texts take PATTERN.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
LATIN_BLANKS = "\t-\r \u0085\u00a0"
LATIN_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[{LATIN_NUMBERS}]+| ?[^{LATIN_BLANKS}{LATIN}{LATIN_NUMBERS}]+|[{LATIN_BLANKS}]+(?![^{LATIN_BLANKS}])|[{LATIN_BLANKS}]+"


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary file writes for each byte: printable Latin-1 stands for itself,
    the other bytes follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normaliser and without prefix space is needed")
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(back[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.token = {i: s for s, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.inside = np.zeros((256, 256), bool)
        for s in self.ids:
            b = np.frombuffer(s, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.pattern = regex.compile(PATTERN)
        self.latin, self.beyond = re.compile(LATIN_PATTERN), re.compile("[\u0250-\U0010ffff]")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        key = np.array([self.ids[a] << 32 | self.ids[b] for a, b in self.rank], np.int64)
        order = np.argsort(key)
        self.pair_keys, self.pair_rank = key[order], order.astype(np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in self.rank], np.int64)
        self.words: dict[str, bytes] = {s: i.to_bytes(4, "little") for s, i in self.added.items()}

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        return (self.pattern if self.beyond.search(text) else self.latin).findall(text)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many fragments at once: rows of equal length, one merge (least rank, leftmost) a row and round."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.array([len(x) for x in pieces])
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            for at in range(0, len(rows), max(1, 400_000 // n)):
                self.merge_rows([pieces[i] for i in rows[at : at + max(1, 400_000 // n)].tolist()], n, rows[at : at + max(1, 400_000 // n)], out)
        return out

    def merge_rows(self, pieces: list[bytes], n: int, rows: np.ndarray, out: list[bytes]) -> None:
        if n > 64:
            for i, p in zip(rows.tolist(), pieces, strict=True):
                out[i] = self.long_fragment([p[j : j + 1] for j in range(n)])
            return
        parts = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, n)]
        ranks = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(parts), np.int64)
            least = ranks[np.arange(len(parts)), best] if ranks.shape[1] else np.full(len(parts), NO_RANK)
            done = least == NO_RANK
            if done.any():
                raw, step = parts[done].astype("<u4").tobytes(), 4 * parts.shape[1]
                for k, i in enumerate(rows[done].tolist()):
                    out[i] = raw[k * step : (k + 1) * step]
                if done.all():
                    return
                parts, ranks, rows, best, least = parts[~done], ranks[~done], rows[~done], best[~done], least[~done]
            r = np.arange(len(parts))
            parts[r, best] = self.merged[least]
            keep = np.ones(parts.shape, bool)
            keep[r, best + 1] = False
            parts = parts[keep].reshape(len(r), -1)
            keep = np.ones(ranks.shape, bool)
            keep[r, best] = False
            ranks = ranks[keep].reshape(len(r), -1)
            width = parts.shape[1]
            q = best > 0
            ranks[r[q], best[q] - 1] = self.pair_ranks(parts[r[q], best[q] - 1], parts[r[q], best[q]])
            q = best < width - 1
            ranks[r[q], best[q]] = self.pair_ranks(parts[r[q], best[q]], parts[r[q], best[q] + 1])

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NO_RANK)

    def long_fragment(self, parts: list[bytes]) -> bytes:
        """The same result for a long fragment: a heap of candidate pairs over a linked list, in n log n steps."""
        n, rank = len(parts), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i] = a + b
            alive[j] = False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return b"".join(self.ids[p].to_bytes(4, "little") for p, ok in zip(parts, alive, strict=True) if ok)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens: cut between bytes that no token has side by side, encode the distinct fragments,
        concatenate."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        off = np.r_[0, np.cumsum([len(x) for x in raw])]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.inside[data[:-1], data[1:]]
        cut[off] = True
        edges = np.flatnonzero(cut).tolist()
        whole = data.tobytes()
        pieces = [whole[x:y] for x, y in zip(edges, edges[1:], strict=False)]
        distinct = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct, self.merge_all(distinct), strict=True))
        where = np.searchsorted(np.array(edges), off).tolist()
        return {w: b"".join([ids[p] for p in pieces[x:y]]) for w, x, y in zip(words, where, where[1:], strict=False)}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers. Words that the bounded table lacks are encoded
        together."""
        parts: list[list[str]] = []
        for text in texts:
            if self.special is None or not any(s in text for s in self.added):
                parts.append(self.split(text))
                continue
            words, at = [], 0
            for m in self.special.finditer(text):
                words += [*self.split(text[at : m.start()]), m.group()]
                at = m.end()
            parts.append(words + self.split(text[at:]))
        known = self.words
        fresh = list(set().union(*parts) - known.keys())
        if fresh:
            known.update(self.encode_words(fresh))
        out = [b"".join(map(known.__getitem__, words)) for words in parts]
        room = len(known) <= CACHE_ENTRIES
        for w in fresh:
            if len(w) > 64 or not room:
                del known[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_CHARS bytes of whole texts, so that a batch's words stay few."""
    for c in chunks(batches, 1, BATCH_CHARS):
        yield c.batch.slice(c.first, len(c))


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids: the encoded text as little-endian 32-bit integers)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for b in small(batches):
            ids = model.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(encode, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from the rows of `bpe_encode`."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    plain = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return plain.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode in one pass: id, `keep` columns, n_tokens, digests of the ids and of the decoded text."""

    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for b in small(batches):
            n, a, z = [], [], []
            for ids in model.encode_batch([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                z.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], names=[id_col, *keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    cols = [id_col, text_col, *(c for c in keep if c not in (id_col, text_col))]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return docs.select(*(F.col(f"`{c}`") for c in cols)).mapInArrow(trip, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string")
