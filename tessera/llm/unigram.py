"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece in a segment; dynamic programming carries the best score and
the piece count only, no back pointers. The tie rule is that of the unigram model of the tokenizers library: from left
to right over the start positions, a strictly better score replaces, so the earliest start (the longest last piece) wins
a tie. A character without a piece of its own costs the unknown score (least score of the vocabulary minus ten) and
neighbouring unknown pieces count as one, as that model fuses them.

A text's blanks become the word mark; a cut is certain before a word mark that follows another letter if no piece has a
word mark behind another letter. Segments between certain cuts are scored each by itself and kept in a bounded table.

The public files hold no unigram model, so the pieces and scores of a BPE vocabulary serve as the unigram vocabulary;
any (piece, score) list can be given instead.

Cases. Null and empty text: no pieces, score 0. Whole texts of any length. An empty table gives an empty one; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_ENTRIES = 300_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0
NONE = float("-inf")
NEVER = -1e8


class UnigramCounter:
    """Best segmentation's score and piece count under a list of (piece, log score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        scores: dict[str, float] = {}
        for s, x in pieces:
            if s:
                scores[s] = x
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for s, x in scores.items():
            self.automaton.add_word(s, (len(s), x))
        if scores:
            self.automaton.make_automaton()
        self.any = bool(scores)
        self.single = {s for s in scores if len(s) == 1}
        mid = any(MARK in s.lstrip(MARK) for s in scores)
        self.segments = regex.compile(".+" if mid else f"{MARK}*[^{MARK}]+|{MARK}+", regex.DOTALL)
        self.known: dict[str, tuple[float, int, bool, bool]] = {}

    def viterbi(self, s: str) -> tuple[float, int, bool, bool]:
        """Score, piece count, and whether the first and the last piece are unknown ones."""
        n = len(s)
        if self.single.issuperset(s):  # no unknown piece; an end's matches come longest first
            best, count = [0.0] + [NONE] * n, [0] * (n + 1)
            for end, (size, x) in self.automaton.iter(s):
                i = end + 1 - size
                if best[i] + x > best[end + 1]:
                    best[end + 1], count[end + 1] = best[i] + x, count[i] + 1
            return best[n], count[n], False, False
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if self.any:
            for end, (size, x) in self.automaton.iter(s):
                matches[end - size + 1].append((size, x))
        best, count = [NONE] * (n + 1), [0] * (n + 1)
        last_unknown, first_unknown = [False] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, single = best[i], False
            for size, x in matches[i]:
                single |= size == 1
                j = i + size
                if here + x > best[j]:
                    best[j], count[j], last_unknown[j] = here + x, count[i] + 1, False
                    first_unknown[j] = first_unknown[i] if i else False
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], last_unknown[i + 1] = here + self.unknown, True
                count[i + 1] = count[i] + (not (i and last_unknown[i]))
                first_unknown[i + 1] = first_unknown[i] if i else True
        return best[n], count[n], first_unknown[n], last_unknown[n]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text."""
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        total, n, known, open_unknown = 0.0, 0, self.known, False
        for s in self.segments.findall(marked):
            got = known.get(s)
            if got is None:
                got = self.viterbi(s)
                if len(s) <= 64 and len(known) < CACHE_ENTRIES:
                    known[s] = got
            total += got[0]
            n += got[1] - (open_unknown and got[2])
            open_unknown = got[3]
        return n, total


def sentencepiece_pieces(path: str) -> list[tuple[str, float]]:
    """The scored pieces of a sentencepiece model file: no control, unknown, unused or byte pieces, and none of those that
    it marks with a score below NEVER."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) or sp.get_score(i) < NEVER
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not skip(i)]


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    return UnigramCounter(sentencepiece_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) of every text; `vocabulary` is a sentencepiece model file that every executor has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary)
        for b in batches:
            got = [model.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([float(x[1]) for x in got], pa.float64())], names=[id_col, "n_tokens", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(counted, f"`{id_col}` {kind}, n_tokens long, score double")
