"""Substring dedup of words (relative Lempel-Ziv) and of bytes (suffix arrays); see `repeats` for how both scale.

Cases of both. Null text is an empty one; documents shorter than a window lose nothing; whole texts of any length. Windows are
judged on the input and never cross documents. Rows with equal id and text are one document, and each gets its result; equal ids
with different texts are different documents, ordered by a hash of the text; a null id comes before all others. An empty table gives
an empty one; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm import rlz, suffix
from tessera.llm.repeats import RepeatFinder


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """Words covered by a window of words that also starts earlier (lesser id, or same document) are removed.

    A row per document: id, n_units (words), n_removed, n_spans, kept_sha256 (kept words joined by one space), and
    kept_text with `text`."""
    return RepeatFinder(window, min(5, window), True, True, rlz.shared_windows, text).find(docs, id_col, text_col)


def suffix_array_dedup(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """Bytes covered by a window of bytes that also starts anywhere else are removed.

    A row per document: id, n_units (bytes), n_removed, n_spans (maximal removed runs), kept_sha256, and with `text`
    kept_text (what is left as UTF-8, without the rest of a character that a cut has split)."""
    return RepeatFinder(window, max(1, min(48, window // 2)), False, False, suffix.shared_windows, text).find(docs, id_col, text_col)
