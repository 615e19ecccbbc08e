"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: each row holds a block of whole documents and, for every term, the ascending
word positions at which it stands in the block (differences, packed). It is written to the shared folder. Only terms that
the tests use are posted while their number stays within `MAX_TERMS`; beyond it all terms are.

Test items are cut into windows of consecutive words. Test windows go to all index rows in blocks of bounded size. In a
row, the postings of a window's rarest term (by its count in the whole corpus) give candidate positions, moved by the
term's offset in the window; they are intersected with the offset-adjusted postings of the next rarer terms in turn until
none is left. With `slop` above 0 a term may stand that many words off its place (proximity match).

Words are compared by a 64-bit hash of their folded bytes.

Cases. Null texts have no words: nothing of a document is hit, an item is ignored. Items without id hit words like others and count
as one item, which has no name. An item with fewer words than a window is one window. Items with equal texts all count as occurring. Documents whose rows repeat get a
row each. Empty tables give empty results, an empty test table leaves all documents clean. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import ALNUM, chunks, covered, ranges, runs, word_hashes, word_spans
from tessera.session import table

BLOCK_WORDS = 300_000  # test words that go to the index at once
MAX_TERMS = 1_000_000
INDEX_BYTES = 1 << 20  # text bytes of an index row
INDEX_SCHEMA = "doc_words binary, terms binary, counts binary, postings binary"


class TestBlock:
    """Windows of some test items: hashes of their words, grouped by length, with the items that hold each."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.windows: dict[int, tuple[np.ndarray, list[list[str | None]]]] = {}
        found: dict[int, dict[bytes, dict[str | None, None]]] = {}
        for item, words in items:
            size = min(window, len(words))
            if size:
                for w in np.lib.stride_tricks.sliding_window_view(words, size):
                    found.setdefault(size, {}).setdefault(w.tobytes(), {})[item] = None
        for size, got in found.items():
            self.windows[size] = (np.frombuffer(b"".join(got), np.uint64).reshape(-1, size), [list(x) for x in got.values()])
        self.terms = np.unique(np.concatenate([w.ravel() for w, _ in self.windows.values()])) if self.windows else np.zeros(0, np.uint64)

    def order(self, counts: dict[int, int]) -> None:
        """Put each window's offsets in the order of its terms' counts in the corpus, the rarest first."""
        by_term = np.array([counts.get(t, 0) for t in self.terms.tolist()], np.int64)
        self.plan = {}
        for size, (words, items) in self.windows.items():
            number = np.searchsorted(self.terms, words)
            offsets = np.argsort(by_term[number], axis=1, kind="stable")
            self.plan[size] = (np.take_along_axis(number, offsets, 1), offsets, items)


def item_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    return word_hashes(data, starts, ends, fold=True)


def test_blocks(tests: DataFrame, id_col: str, text_col: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[TestBlock]:
    """Read the test items in blocks of bounded size."""
    held, n = [], 0
    rows = tests.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").alias("_text")).dropna(subset="_text")
    for item, text in rows.toLocalIterator():
        words = item_words(text)
        held.append((item, words))
        n += len(words)
        if n >= block_words:
            yield TestBlock(held, window)
            held, n = [], 0
    if held:
        yield TestBlock(held, window)


def build_index(docs: DataFrame, id_col: str, text_col: str, terms: np.ndarray | None) -> DataFrame:
    """The positional index of `docs` in the shared folder; `terms` restricts the postings to those (sorted hashes)."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for c in chunks(batches, "text", INDEX_BYTES):
            starts, ends, first = word_spans(c.data, c.off, ALNUM)
            h = word_hashes(c.data, starts, ends, fold=True)
            at = np.arange(len(h), dtype=np.int32)
            if terms is not None and len(h):
                if len(terms):
                    near = np.searchsorted(terms, h)
                    near[near == len(terms)] = 0
                    at = np.flatnonzero(terms[near] == h).astype(np.int32)
                    number = near[at].astype(np.int32)
                    order = np.argsort(number, kind="stable")
                    at, key = at[order], terms[number[order]]
                else:
                    at, key = at[:0], h[:0]
            else:
                order = np.argsort(h, kind="stable")
                at, key = at[order], h[order]
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            step = np.diff(at, prepend=np.int32(0))
            step[head] = at[head]
            cells = [np.diff(first).astype(np.int32).tobytes(), key[head].tobytes(), np.diff(np.r_[head, len(key)]).astype(np.int32).tobytes(), pack.compress(step.astype(np.int32).tobytes())]
            ids = pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.column("id"))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in cells)], names=["ids", "doc_words", "terms", "counts", "postings"])

    kind = docs.schema[id_col].dataType.simpleString()
    return table(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(posted, f"ids array<{kind}>, {INDEX_SCHEMA}"))


def term_counts(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """Counts in the corpus of the wanted terms (those of one test block, so bounded)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for t, n in zip(b.column(0), b.column(1), strict=True):
                terms, counts = np.frombuffer(t.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int32)
                if len(terms) and len(wanted):
                    at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
                    ok = wanted[at] == terms
                    total[at[ok]] += counts[ok]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {int(wanted[r[0]]): r[1] for r in rows}


def phrase_hits(block: TestBlock, words: np.ndarray, terms: np.ndarray, counts: np.ndarray, at: np.ndarray, slop: int) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(positions, lengths, items) of all matches in one index row."""
    n = int(words.sum())
    bounds = np.r_[0, np.cumsum(words)]
    owner = np.repeat(np.arange(len(words)), words)
    where = np.searchsorted(terms, block.terms)
    where[where == len(terms)] = 0
    have = (terms[where] == block.terms) if len(terms) else np.zeros(len(block.terms), bool)
    size = np.where(have, counts[where], 0) if len(terms) else np.zeros(len(block.terms), np.int64)
    start = (np.cumsum(counts) - counts)[where] if len(terms) else size
    token = np.full(n, -1, np.int64)
    for_block = np.full(len(terms), -1, np.int64)
    for_block[where[have]] = np.flatnonzero(have)
    token[at] = np.repeat(for_block, counts)
    out = []
    for length, (number, offsets, items) in block.plan.items():
        alive = np.flatnonzero((size[number] > 0).all(1))
        rare = number[alive, 0]
        window = np.repeat(alive, size[rare])
        place = at[ranges(start[rare], size[rare])].astype(np.int64) - offsets[window, 0]
        ok = (place >= 0) & (place + length <= n)
        window, place = window[ok], place[ok]
        ok = owner[place] == owner[place + length - 1]
        window, place = window[ok], place[ok]
        for k in range(1, length):
            if not len(place):
                break
            spot, want = place + offsets[window, k], number[window, k]
            ok = token[spot] == want
            for d in range(1, slop + 1):
                for s in (spot - d, spot + d):
                    inside = (s >= bounds[owner[place]]) & (s < bounds[owner[place] + 1])
                    ok |= inside & (token[np.where(inside, s, 0)] == want)
            window, place = window[ok], place[ok]
        for w, p in zip(window.tolist(), place.tolist(), strict=True):
            out.append((p, length, items[w]))
    return out


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_hit, hit spans in words, and the items with an occurring window."""
    terms, number = [], 0
    for b in test_blocks(tests, item_col, item_text_col, window, block_words):
        number += len(b.terms)
        if number > MAX_TERMS:
            break
        terms.append(b.terms)
    every = number > MAX_TERMS
    index = build_index(docs, id_col, text_col, None if every else np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64))
    kind = docs.schema[id_col].dataType.simpleString()
    hits = "hit_at array<int>, hit_len array<int>, hit_items array<array<string>>"
    found = index.select("*", F.expr("cast(array() as array<int>)").alias("hit_at"), F.expr("cast(array() as array<int>)").alias("hit_len"), F.expr("cast(array() as array<array<string>>)").alias("hit_items"))
    for i, block in enumerate(test_blocks(tests, item_col, item_text_col, window, block_words)):
        block.order(term_counts(index, block.terms))
        if i % 8 == 7:
            found = table(found)
        found = found.mapInArrow(_searcher(block, slop), f"ids array<{kind}>, {INDEX_SCHEMA}, {hits}")
    return found.select("ids", "doc_words", "hit_at", "hit_len", "hit_items").mapInArrow(_by_document, f"ids {kind}, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>").withColumnRenamed("ids", id_col)


def _searcher(block: TestBlock, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                cell = lambda name, kind: np.frombuffer(b.column(name)[r].as_py(), kind)  # noqa: E731, B023
                counts = cell("counts", np.int32).astype(np.int64)
                step = np.frombuffer(unpack.decompress(b.column("postings")[r].as_py()), np.int32).astype(np.int64)
                total = np.cumsum(step)
                head = np.cumsum(counts) - counts
                at = total - np.repeat(total[head] - step[head], counts) if len(counts) else total
                got = phrase_hits(block, cell("doc_words", np.int32), cell("terms", np.uint64), counts, at, slop)
                rows.append([b.column("hit_at")[r].as_py() + [x[0] for x in got], b.column("hit_len")[r].as_py() + [x[1] for x in got], b.column("hit_items")[r].as_py() + [x[2] for x in got]])
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("ids", "doc_words", "terms", "counts", "postings")), *(pa.array([x[k] for x in rows], kinds[k]) for k in range(3))], names=["ids", "doc_words", "terms", "counts", "postings", "hit_at", "hit_len", "hit_items"])

    return search


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            words = np.frombuffer(b.column("doc_words")[r].as_py(), np.int32).astype(np.int64)
            bounds = np.r_[0, np.cumsum(words)]
            at = np.array(b.column("hit_at")[r].as_py(), np.int64)
            size = np.array(b.column("hit_len")[r].as_py(), np.int64)
            owner = np.searchsorted(bounds, at, "right") - 1
            spans: list[list[dict]] = [[] for _ in words]
            items: list[set] = [set() for _ in words]
            hit = np.zeros(len(words), np.int64)
            for d, got in zip(owner.tolist(), b.column("hit_items")[r].as_py(), strict=True):
                items[d].update(got)
            for d in np.unique(owner).tolist():
                q = owner == d
                s, e = runs(covered(int(words[d]), at[q] - bounds[d], at[q] + size[q] - bounds[d]))
                hit[d] = (e - s).sum()
                spans[d] = [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("ids")[r].values, pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, kind), pa.array([sorted(x, key=lambda i: (i is None, i or "")) for x in items], pa.list_(pa.string()))], names=["ids", "n_words", "n_hit", "spans", "items"])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()
