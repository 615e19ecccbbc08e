"""The words' sentence context of `operators.folds.sentence_context`, over a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FIELDS = ["at", "id", "name", "own", "tail", "sentence_char", "split"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """The fold of one timeline's words in their order: what it keeps is the last words of the sentences that ended, and the last
    placed word's sentence, place, split and what a context can hold of the sentence."""

    def __init__(self, max_context: int, past: str = "", prev: tuple | None = None):
        self.keep, self.past, self.prev = max_context + 1, past, prev

    def ended(self, sentence: str) -> None:
        first, *rest = (self.past + sentence).rsplit(" ", self.keep)
        # the blank before the first word stays, so that what comes before it is not joined to it
        self.past = "".join(f" {x}" for x in rest) if len(rest) == self.keep else " ".join([first, *rest])

    def word(self, text: str | None, sentence: str | None, at: float | None, split: str | None) -> str:
        """The context of the next word."""
        own = sentence[: max(0, int(at + len(text or "")))] if sentence and at is not None and at == at else ""
        return self.cut_word(sentence or None, own, sentence, at, split)

    def cut_word(self, name: object, own: str | None, tail: str | None, at: float | None, split: str | None) -> str:
        """The same from a name of its sentence (None: outside all), the sentence up to the word's end and the whole sentence,
        both cut to their last words or not."""
        prev = self.prev
        if name is None:
            if prev and prev[2] != split:
                self.past = ""
            self.prev = None
            return ""
        if at is None or at != at:
            return ""
        if prev and name != prev[0] and at <= prev[1]:
            if prev[2] != split:
                self.past = ""
            else:
                self.ended(prev[3])
        self.prev = (name, at, split, tail)
        return " ".join((self.past + own).split(" ")[-self.keep :])


class ContextProcessor(StatefulProcessor):
    """Words wait in a list until the watermark has passed them; a timer at the first of them wakes their timeline.

    The words of a timeline that come in one micro-batch are one element of the list, as each element is a trip to the state store."""

    def __init__(self, max_context: int):
        self.max_context = max_context

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "words binary")
        self.state = handle.getValueState("fold", "past string, name binary, sentence_char double, split string, tail string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        columns: list[list] = [[] for _ in FIELDS]
        for f in rows:
            for values, name in zip(columns, FIELDS, strict=True):
                values += _plain(f[name])
        if columns[0]:
            self.waiting.appendValue((pickle.dumps(columns),))
            self.handle.registerTimer(_millis(min(columns[0])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [r for (words,) in self.waiting.get() for r in zip(*pickle.loads(words), strict=True)]
        due, later = sorted((r for r in held if r[0] <= until), key=lambda r: r[:2]), [r for r in held if r[0] > until]
        if not due:
            return
        past, *prev = self.state.get() or ("", None, None, None, None)
        fold = Fold(self.max_context, past, (bytes(prev[0]), *prev[1:]) if prev[0] is not None else None)
        out = [fold.cut_word(*r[2:]) for r in due]
        self.state.update((fold.past, *(fold.prev or (None, None, None, None))))
        if later:
            self.waiting.put([(pickle.dumps([list(c) for c in zip(*later, strict=True)]),)])
            self.handle.registerTimer(_millis(min(r[0] for r in later)))
        else:
            self.waiting.clear()
        yield pd.DataFrame({"id": [r[1] for r in due], "context": out})

    def close(self) -> None:
        """Nothing is held outside the state."""


def _plain(column: pd.Series) -> list:
    """A column's values as Python's own; what is missing as None."""
    values = [x.tolist() if hasattr(x, "tolist") else x for x in column.tolist()]
    return [None if isinstance(x, float) and x != x else bytes(x) if isinstance(x, bytearray) else x for x in values]


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def streamed_context(stream: DataFrame, max_context: int, late: str) -> DataFrame:
    """(id, context) of the words of a stream (id, timeline, ts, text, sentence, sentence_char, split), as the batch operator gives
    them in the order of (ts, id). An id is a number, a text or an array of either.

    Words may come in any order within `late` of the newest one: each is answered once, when the watermark has passed it. Words
    that come later than that, or at or before the first second of 1970, are left out, as if they had not been said. The state of a timeline is its waiting words, each
    with at most `max_context` + 1 words of its sentence, and as many words of the past and of one sentence. Needs the session's state store to be RocksDB (`ROCKSDB`)."""
    kind, keep = stream.schema["id"].dataType.simpleString(), max_context + 1

    def cut(text: Column) -> Column:
        # the blank before the first word that is kept stays, as in the batch operator
        end = F.substring_index(text, " ", -keep)
        return F.when(F.length(end) < F.length(text), F.concat(F.lit(" "), end)).otherwise(text)

    # words carry no more than contexts can hold, and name their sentence by a digest
    at = F.col("sentence_char").cast("double")
    own = F.substring("sentence", F.lit(1), (F.when(~F.isnan(at), at) + F.coalesce(F.length("text"), F.lit(0))).cast("int"))
    inside = F.col("sentence") != ""
    rows = stream.select("id", "timeline", F.col("ts").cast("timestamp").alias("ts"), F.when(inside, F.unhex(F.sha2("sentence", 256))).alias("name"), F.when(inside, cut(own)).alias("own"), F.when(inside, cut(F.col("sentence"))).alias("tail"), at.alias("sentence_char"), "split")
    rows = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("timeline").transformWithStateInPandas(ContextProcessor(max_context), f"id {kind}, context string", "Append", "EventTime")
