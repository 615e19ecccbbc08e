"""Language-model scores from class bigrams (Brown classes by exchange clustering).

Words (ASCII letters folded) are units of the clustering: each of the FREQUENT most frequent training words is one, every other
word belongs at first to the unit of its last two bytes, and the end of a text is one. Bigram counts of units over all training
documents go to the driver (their number is fixed by UNITS); exchange clustering moves one unit at a time to the class
that raises the class bigram likelihood most, until a pass moves none. Then each further word of the training vocabulary is
clustered by itself: its counts of classes before and behind it, a distributed table that grows with the vocabulary, name the class
that favours them most. Class bigrams and emissions are counted anew with every word in its own class; only words that
training has not seen take the class of their ending.

P(word | history) = P(class | class before) * P(word | class), with (n + 0.5) / (N + 0.5 C) for transitions and (count + 1) /
(class tokens + class words + 1) for emissions, where one share a class is that of unknown words. The sum of log10(count + 1)
over a document's words, which the base score and the emissions share, comes from the TOP words' counts in the closure
(a fixed number) and, for all other words, from a join on the word, as do classes: neither is collected or cut off.

Cases. Null and empty texts have one token, the end. A null id counts as training. Every row is a document of its own and
counts by itself, also where it repeats an id or a text. Without training tokens every count is 0. An empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import NOT_BLANK, chunks, word_hashes, word_spans
from tessera.session import table

FREQUENT, ENDINGS, CLASSES, TOP = 360, 151, 40, 50_000
UNITS = FREQUENT + ENDINGS + 1  # the last is the end of a text
HELD = 1 << 20  # distinct words that a task gathers before it sends their counts on
PASSES = 12
PLACES = 1 << 20  # contexts that a task gathers before it sends their counts on; well below 1 << 24
_U = np.uint64


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ending units of all words, and the documents' bounds."""
    starts, ends, first = word_spans(data, off, NOT_BLANK)
    h = word_hashes(data, starts, ends, fold=True)
    if not len(h):
        return h, np.zeros(0, np.int64), first
    last, before = data[ends - 1].astype(np.int64), np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    fold = lambda b: np.where((b >= 65) & (b <= 90), b + 32, b)
    return h, (fold(last) * 31 + fold(before)) % ENDINGS, first


class Lexicon:
    """Units of words: a sorted list of the frequent words' hashes with their numbers."""

    def __init__(self, frequent: np.ndarray):
        self.order = np.argsort(frequent)
        self.sorted = frequent[self.order]

    def units(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        if not len(self.sorted) or not len(h):
            return FREQUENT + ending
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], FREQUENT + ending)


def sequence(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of all documents with an end behind each, and the places of the ends."""
    n = len(first) - 1
    ends = first[1:] + np.arange(n)
    out = np.full(len(units) + n, UNITS - 1, np.int64)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = units
    return out, ends


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def send(h, t, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.astype(np.int32)), pa.array(n)], names=["h", "t", "n"])

    h, t, n = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for c in chunks(batches):
        one, ending, _ = words_of(c.data, c.off)
        both = np.concatenate([h, one])
        h, at, where = np.unique(both, return_index=True, return_inverse=True)
        t = np.concatenate([t, ending])[at]
        n = np.bincount(where, np.concatenate([n, np.ones(len(one), np.int64)]), len(h)).astype(np.int64)
        if len(h) > HELD:
            yield send(h, t, n)
            h, t, n = h[:0], t[:0], n[:0]
    if len(h):
        yield send(h, t, n)


def _unit_bigrams(lexicon: Lexicon):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, np.int64)
        for c in chunks(batches):
            h, ending, first = words_of(c.data, c.off)
            seq, _ = sequence(lexicon.units(h, ending), first)
            total += np.bincount(np.r_[UNITS - 1, seq[:-1]] * UNITS + seq, minlength=UNITS * UNITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["k", "n"])

    return count


def _contexts(lexicon: Lexicon, owner: np.ndarray):
    """How often each class stands before (k) and behind (CLASSES + k) each word that is not a unit of its own: a row for a word and
    about PLACES of its places, its counts as numbers of 32 bits, k in the highest 8."""

    def send(w: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((k, w))
        w, k = w[order], k[order]
        new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (k[1:] != k[:-1])])
        cells = (k[new] << 24 | np.diff(np.r_[new, len(w)])).astype(np.uint32)
        w = w[new]
        head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        bounds = (np.r_[head, len(w)] * 4).astype(np.int32)
        near = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(cells.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(w[head].view(np.int64)), near], names=["h", "near"])

    def sent(ws: list[np.ndarray], ks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        w, k = np.concatenate(ws), np.concatenate(ks)
        for x in range(0, len(w), 2 * PLACES):
            yield send(w[x : x + 2 * PLACES], k[x : x + 2 * PLACES])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, ks, held = [], [], 0
        for c in chunks(batches):
            h, ending, first = words_of(c.data, c.off)
            units = lexicon.units(h, ending)
            seq, _ = sequence(units, first)
            k = owner[seq]
            more = np.flatnonzero(units >= FREQUENT)
            at = more + np.searchsorted(first, more, "right") - 1
            ws.append(np.tile(h[more], 2))
            ks.append(np.r_[np.r_[CLASSES - 1, k[:-1]][at], CLASSES + k[at + 1]])
            held += 2 * len(more)
            if held >= PLACES:
                yield from sent(ws, ks)
                ws, ks, held = [], [], 0
        if held:
            yield from sent(ws, ks)

    return count


def _favoured(grid: np.ndarray):
    """The class whose mutual information with the classes around a word is largest over all its places."""
    row, col = (grid.sum(x, keepdims=True) + 0.5 * CLASSES for x in (1, 0))
    shared = np.log((grid + 0.5) * (grid.sum() + 0.5 * CLASSES * CLASSES) / (row * col))
    value = np.concatenate([shared, shared.T])[:, :-1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("near")
            cells = lists.flatten()
            raw = np.frombuffer(b"".join(cells.to_pylist()), np.uint32)
            size = pc.binary_length(cells).to_numpy(zero_copy_only=False) // 4
            doc = np.repeat(np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), size)
            k, n = (raw >> np.uint32(24)).astype(np.int64), (raw & np.uint32(0xFFFFFF)).astype(np.int64)
            around = np.bincount(doc * (2 * CLASSES) + k, n, b.num_rows * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array((around @ value).argmax(1).astype(np.int32))], names=["h", "c"])

    return assign


def _patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the joined words' classes into the documents' sequences of classes, all of a batch at once."""
    for b in batches:
        cells = b.column("seq").to_pylist()
        off = np.r_[0, np.cumsum([len(x) for x in cells])]
        seq = np.frombuffer(b"".join(cells), np.uint8).copy()
        size = pc.fill_null(pc.list_value_length(b.column("more")), 0).to_numpy(zero_copy_only=False)
        flat = b.column("more").flatten()
        places, kind = flat.field("p"), flat.field("c").to_numpy(zero_copy_only=False)
        each = pc.binary_length(places).to_numpy(zero_copy_only=False) // 4
        start = np.repeat(np.repeat(off[:-1], size), each)
        seq[start + np.frombuffer(b"".join(places.to_pylist()), np.int32)] = np.repeat(kind, each)
        raw = seq.tobytes()
        seqs = pa.array([raw[x:y] for x, y in zip(off.tolist(), off[1:].tolist(), strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("d", "held", "n_tokens", "n_known", "logs")), seqs], names=["d", "held", "n_tokens", "n_known", "logs", "seq"])


def _class_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for b in batches:
        k = np.frombuffer(b"".join(b.column("seq").to_pylist()), np.uint8).astype(np.int64)
        total += np.bincount(np.r_[CLASSES - 1, k[:-1]] * CLASSES + k, minlength=CLASSES * CLASSES) if len(k) else 0
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["k", "n"])


def exchange_classes(counts: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each unit. The last unit, the end, keeps a class of its own. Starts with units dealt by their rank."""
    n = len(counts)
    rank = np.argsort(np.argsort(-counts.sum(1)[:-1], kind="stable"))
    owner = np.r_[rank % (classes - 1), classes - 1]
    xlx = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1)), 0.0)
    counts = counts.astype("f8")
    by_right = np.zeros((n, classes))
    by_left = np.zeros((n, classes))
    for u in range(n):
        by_right[:, owner[u]] += counts[:, u]
        by_left[:, owner[u]] += counts[u, :]
    grid = np.zeros((classes, classes))
    np.add.at(grid, owner, by_right)
    row, col = grid.sum(1), grid.sum(0)
    for _ in range(passes):
        moved = 0
        for u in np.argsort(-counts[:-1].sum(1), kind="stable").tolist():
            if not counts[u].any() and not counts[:, u].any():
                continue
            was, out, into, own = owner[u], by_right[u].copy(), by_left[u].copy(), counts[u, u]
            out[was] -= own
            into[was] -= own
            total_out, total_in = counts[u].sum(), counts[:, u].sum()
            grid[was] -= out
            grid[:, was] -= into
            grid[was, was] -= own
            row[was] -= total_out
            col[was] -= total_in
            # adding u to class k changes row k, column k and the cell (k, k) of the grid
            gain = (xlx(grid + out[None, :]) - xlx(grid)).sum(1) + (xlx(grid + into[:, None]) - xlx(grid)).sum(0)
            d = np.diagonal(grid)
            dk = np.arange(classes)
            gain += xlx(d + out[dk] + into[dk] + own) - xlx(d + out[dk]) - xlx(d + into[dk]) + xlx(d)
            gain -= xlx(row + total_out) - xlx(row) + xlx(col + total_in) - xlx(col)
            gain[classes - 1] = -np.inf
            to = int(gain.argmax())
            if gain[to] <= gain[was] + 1e-9:
                to = was
            grid[to] += out
            grid[:, to] += into
            grid[to, to] += own
            row[to] += total_out
            col[to] += total_in
            if to != was:
                moved += 1
                owner[u] = to
                by_right[:, was] -= counts[:, u]
                by_right[:, to] += counts[:, u]
                by_left[:, was] -= counts[u, :]
                by_left[:, to] += counts[u, :]
        if not moved:
            break
    return owner


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(d, text, id) with a number for each row, and (d, id) where that number is not the id itself."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        n, ids, distinct = texts.agg(F.count("*"), F.count("id"), F.count_distinct("id")).first()
        if n == ids == distinct:
            return texts.select(F.col("id").cast("long").alias("d"), "text", "id"), None
    rows = table(texts.withColumn("d", F.monotonically_increasing_id()))
    return rows.select("d", "text", "id"), rows.select("d", "id")


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), and the
    perplexity that the score means for a token.

    `held_out` is a condition over the column `id`: where it is true, a document trains nothing."""
    texts, names = numbered(docs, id_col, text_col)
    flagged = texts.withColumn("held", F.coalesce(held_out, F.lit(False)))
    train = flagged.filter(~F.col("held")).select("text")
    vocabulary = table(train.mapInArrow(_word_counts, "h long, t int, n long").groupBy("h").agg(F.min("t").alias("t"), F.sum("n").alias("n")))
    ends = train.count()
    # frequent words: those of the highest steps of a histogram of counts that hold at most TOP words together
    step_of = F.floor(F.log2("n") * 16)
    above, least = 0, None
    for step, words in sorted(vocabulary.groupBy(step_of.alias("k")).agg(F.count("*").alias("w")).collect(), reverse=True):
        above += words
        if above > TOP:
            break
        least = step
    frequent = vocabulary.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").collect()
    frequent_h = np.array([r[0] for r in frequent], np.int64).view(_U)
    lexicon = Lexicon(frequent_h)
    counts = np.zeros(UNITS * UNITS, np.int64)
    for k, n in train.mapInArrow(_unit_bigrams(lexicon), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[k] = n
    counts = counts.reshape(UNITS, UNITS)
    owner = exchange_classes(counts)
    grid = np.zeros((CLASSES, CLASSES))
    np.add.at(grid, (owner[:, None].repeat(UNITS, 1), owner[None, :].repeat(UNITS, 0)), counts)
    # each further word takes the class that its own neighbours favour
    near = train.mapInArrow(_contexts(lexicon, owner), "h long, near binary").groupBy("h").agg(F.collect_list("near").alias("near"))
    classed = near.mapInArrow(_favoured(grid), "h long, c int")
    words_c = table(vocabulary.join(classed, "h", "left").select("h", "n", "c"))
    unit_of = {int(x): u for u, x in enumerate(frequent_h.view(np.int64))}
    top = [] if least is None else sorted(words_c.filter(step_of >= least).collect())
    top_sorted = np.array([r[0] for r in top], np.int64).view(_U)
    order = np.argsort(top_sorted)
    top_sorted, top_log = top_sorted[order], np.log10(np.array([r[1] for r in top], np.int64)[order] + 1.0)
    top_class = np.array([owner[unit_of[r[0]]] if r[2] is None else r[2] for r in top], np.int64)[order]
    class_v = np.bincount(owner[: len(frequent_h)], minlength=CLASSES)
    total, words = ends, int(ends > 0)
    for c, n, v in words_c.groupBy("c").agg(F.sum("n"), F.count("*")).collect():
        total, words = total + n, words + v
        if c is not None:
            class_v[c] += v
    class_v[-1] += ends > 0
    end_log, base = float(np.log10(ends + 1)), float(np.log10(total + words + 1))

    def known(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are among the TOP, and their places there."""
        if not len(top_sorted) or not len(h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(top_sorted, h), len(top_sorted) - 1)
        return top_sorted[at] == h, at

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            h, ending, first = words_of(c.data, c.off)
            seq, last = sequence(lexicon.units(h, ending), first)
            k = owner[seq]
            ok, at = known(h)
            place = np.flatnonzero(ok)
            k[place + np.searchsorted(first, place, "right") - 1] = top_class[at[place]]
            k = k.astype(np.uint8)
            logs = np.r_[0.0, np.cumsum(np.where(ok, top_log[at], 0.0) if len(top_log) else np.zeros(len(h)))]
            seen = np.r_[0, np.cumsum(ok)]
            head = np.r_[0, last[:-1] + 1][: len(last)]
            yield pa.RecordBatch.from_arrays(
                [c.column("d"), c.column("held"), pa.array(np.diff(first) + 1), pa.array(np.diff(seen[first]) + (ends > 0)), pa.array(np.diff(logs[first]) + end_log), pa.array([k[x : y + 1].tobytes() for x, y in zip(head, last, strict=True)], pa.binary())],
                names=["d", "held", "n_tokens", "n_known", "logs", "seq"],
            )

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            h, _, first = words_of(c.data, c.off)
            rest = np.flatnonzero(~known(h)[0])
            doc = np.searchsorted(first, rest, "right") - 1
            place = (rest - first[doc]).astype(np.int32)
            order = np.lexsort((h[rest], doc))
            doc, w, place = doc[order], h[rest[order]], place[order]
            new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])]) if len(w) else np.zeros(0, np.int64)
            size = np.diff(np.r_[new, len(w)])
            places = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((np.r_[new, len(w)] * 4).astype(np.int32).tobytes()), pa.py_buffer(place.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(w[new].view(np.int64)), c.column("d").take(pa.array(doc[new])), pa.array(size.astype(np.int32)), places], names=["h", "d", "m", "p"])

    kinds = "d long, held boolean, n_tokens long, n_known long, logs double, seq binary"
    rare = words_c if least is None else words_c.filter(step_of < least)
    if least is None or len(top) < FREQUENT:  # frequent words that the closure does not hold
        named = docs.sparkSession.createDataFrame([(x, int(owner[u])) for x, u in unit_of.items()], "h long, own int")
        rare = rare.join(F.broadcast(named), "h", "left").withColumn("c", F.coalesce("c", "own")).drop("own")
    looked = texts.select("d", "text").mapInArrow(others, "h long, d long, m int, p binary").join(rare, "h")
    looked = looked.groupBy("d").agg(F.sum("m").alias("k"), F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("l"), F.collect_list(F.struct("p", "c")).alias("more"))
    placed = flagged.select("d", "text", "held").mapInArrow(sequences, kinds).join(looked, "d", "left")
    placed = placed.withColumn("n_known", F.col("n_known") + F.coalesce("k", F.lit(0))).withColumn("logs", F.col("logs") + F.coalesce("l", F.lit(0.0)))
    sequenced = table(placed.select("d", "held", "n_tokens", "n_known", "logs", "seq", "more").mapInArrow(_patched, kinds))
    final = np.zeros(CLASSES * CLASSES)
    for k, n in sequenced.filter("not held").mapInArrow(_class_bigrams, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        final[k] = n
    final = final.reshape(CLASSES, CLASSES)
    step = np.log10((final + 0.5) / (final.sum(1, keepdims=True) + 0.5 * CLASSES)) - np.log10(final.sum(0) + class_v + 1)[None, :]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.frombuffer(b"".join(b.column("seq").to_pylist()), np.uint8).astype(np.int64)
            sums = np.r_[0.0, np.cumsum(step[np.r_[CLASSES - 1, k[:-1]][: len(k)], k])]
            to = np.cumsum(b.column("n_tokens").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("d", "held", "n_tokens", "n_known", "logs")), pa.array(sums[to] - sums[np.r_[0, to[:-1]][: len(to)]])], names=["d", "held", "n_tokens", "n_known", "logs", "moves"])

    scored = sequenced.mapInArrow(moved, "d long, held boolean, n_tokens long, n_known long, logs double, moves double")
    logs = F.col("logs")
    out = scored.select(
        "d", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(base)).alias("base_score"), (logs + F.col("moves")).alias("score"),
    )
    if names is not None:
        out = names.join(out, "d").drop("d").withColumnRenamed("id", id_col)
    else:
        out = out.withColumn("d", F.col("d").cast(docs.schema[id_col].dataType)).withColumnRenamed("d", id_col)
    return out.select(F.col(f"`{id_col}`"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
