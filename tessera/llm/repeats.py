"""Repeated windows of a corpus: the routing that substring dedup (words) and suffix-array dedup (bytes) share.

Windows that are equal pick equal anchors (`text.Anchors`), so only documents that share an anchor can share a window. The
steps, none of which holds a group in one task or emits pairs:

1. Anchors of all documents are counted (partial aggregation; a few numbers for each anchor). Those that occur once are done.
2. An anchor whose occurrences all have the same span is decided by that alone: every window of it is repeated, and its
   first occurrence is known. Exact copies, however many, end here.
3. For an anchor with several distinct spans, each distinct span counts once, by its first occurrence. Repeats of a span are
   repeated windows; the distinct spans' contents go to shards by anchor, where an engine (Lempel-Ziv factors or suffix
   arrays) finds the windows that two spans share.
4. An anchor with more than HOT distinct spans would make a large shard. Its spans are cut into pieces of `step` neighbouring
   windows, at the same distances from the anchor everywhere, and each piece goes by the units that all its windows have in
   common: only pieces that agree in those can share a window. Pieces are decided and sharded as anchors are (2, 3); what is
   still crowded is cut again, by a smaller step, at last into single windows, which their hashes decide. So a crowded anchor
   sends a row for `step` windows, and only what agrees in nearly a window's length is cut further.
5. Each document's covered units are removed. Documents without contents in a shard are finished as their text is first
   read; the others are kept in the shared folder until the shards are done.

Keys: ids that are unique integers are used as they are. Otherwise (null, repeated or other ids) documents are numbered in
the order of (id, hash of text), null first; rows that repeat id and text are documents of their own: as windows of one also
start in the other, op5 removes both, and op1 all but one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.skew import join_frequent
from tessera.llm.text import BYTE_VALUES, NOT_BLANK, Anchors, Chunk, chunks, give_back, mix, ranges, runs, span_hashes, word_hashes, word_spans
from tessera.session import table

HOT = 500
STEPS = (16, 4, 1)  # windows of a piece, from round to round; at most a fifth of a window's units, or 1
SHARD_UNITS = 1 << 18  # units of contents that an engine gets at once, whole anchors at least
RESULT = "n_units long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
COLUMNS = ["n_units", "n_removed", "n_spans", "kept_sha256", "kept_text"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_U = np.uint64


class Units:
    """The units of a chunk: hashes, bounds of the documents, and what is left of a document without some of them."""

    def __init__(self, chunk: Chunk, words: bool):
        self.chunk, self.words = chunk, words
        if words:
            self.starts, self.ends, self.bounds = word_spans(chunk.data, chunk.off, NOT_BLANK)
            self.hashes = word_hashes(chunk.data, self.starts, self.ends)
        else:
            self.bounds, self.hashes = chunk.off, BYTE_VALUES[chunk.data]

    def content(self, x: int, y: int) -> bytes:
        return (self.hashes if self.words else self.chunk.data)[x:y].tobytes()

    def kept(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that are left, and their n+1 offsets: bytes as they are, words joined by one space."""
        data, off = self.chunk.data, self.chunk.off
        if not self.words:
            mask = ~gone
        else:
            data = data.copy()
            keep = np.flatnonzero(~gone)
            owner = np.searchsorted(off, self.starts[keep], "right")
            mask = np.zeros(len(data) + 1, np.int8)
            np.add.at(mask, self.starts[keep], 1)
            np.add.at(mask, self.ends[keep], -1)
            mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
            gap = self.ends[keep[:-1]][owner[:-1] == owner[1:]]
            data[gap] = 0x20
            mask[gap] = True
        return data[mask], np.r_[0, np.cumsum(mask)][off]

    def results(self, gone: np.ndarray, text: bool) -> list[tuple]:
        """The result columns of each document."""
        left, off = self.kept(gone)
        total = np.r_[0, np.cumsum(gone)]
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        heads = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]
        first[heads] = gone[heads]
        spans = np.r_[0, np.cumsum(first)]
        at = self.bounds
        raw = memoryview(left.tobytes())
        whole = [str(raw[x:y], "utf-8", "ignore") if text else None for x, y in zip(off.tolist(), off[1:].tolist(), strict=False)]
        digest = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(off.tolist(), off[1:].tolist(), strict=False)]
        return list(zip(np.diff(at).tolist(), np.diff(total[at]).tolist(), np.diff(spans[at]).tolist(), digest, whole, strict=True))


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(d, text, id) with one row for each row of `docs`, and (d, id) of all of them where `d` is not the id itself.

    Where ids are missing or repeat, rows are numbered by id, then text; rows that repeat both are documents of their own.
    Ids with texts are counted before they are numbered, so that many copies of a row never meet in one task."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        n, ids, distinct = texts.agg(F.count("*"), F.count("id"), F.count_distinct("id")).first()
        if n == ids == distinct:
            return texts.select(F.col("id").cast("long").alias("d"), "text", "id"), None
    keyed = texts.withColumn("h", F.sha2("text", 256))
    counted = keyed.groupBy("id", "h").agg(F.count("*").alias("copies"))
    order = counted.orderBy("id", "h").rdd.zipWithIndex().map(lambda r: (r[0]["id"], r[0]["h"], r[0]["copies"], r[1]))
    kind = docs.schema[id_col].dataType
    fields = [("i", kind), ("h", T.StringType()), ("copies", T.LongType()), ("k", T.LongType())]
    names = table(docs.sparkSession.createDataFrame(order, T.StructType([T.StructField(*f) for f in fields])))
    # a row's further copies are numbered behind all first ones: a window's first place is then in the first copy of the least id
    many = names.count()
    one = keyed.groupBy("id", "h").agg(F.first("text").alias("text"))
    rows = one.join(names, [one["id"].eqNullSafe(names["i"]), one["h"] == names["h"]])
    rows = rows.select("id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "k")
    rows = table(rows.select((F.col("copy") * many + F.col("k")).alias("d"), "id", "text"))
    return rows, rows.select("d", "id")


def pack(x: np.ndarray) -> bytes:
    return np.asarray(x, np.int32).tobytes()


def unpack(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", np.int32).astype(np.int64)


def listed(lists: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the lists of a column (null: 0), and the fields of all their elements, one list after another."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return size, [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


class RepeatFinder:
    """`window`: units of a window; `k`: units of an anchor; `words`: words or bytes; `earlier`: a window is removed only if
    it occurs before, else if it occurs anywhere else; `engine`: finds shared windows in a shard;
    `text`: return the text that is left, too."""

    def __init__(self, window: int, k: int, words: bool, earlier: bool, engine: Callable, text: bool = False):
        self.window, self.k, self.words, self.earlier, self.engine, self.text = window, k, words, earlier, engine, text

    def anchors(self, chunk: Chunk) -> tuple[Units, Anchors, np.ndarray]:
        u = Units(chunk, self.words)
        a = Anchors(u.hashes, u.bounds, self.window, self.k)
        return u, a, np.searchsorted(u.bounds, a.at, "right") - 1

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            u, a, doc = self.anchors(c)
            d = c.column("d").to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(a.gram.view(np.int64)), pa.array(a.span.view(np.int64)), pa.array(d), pa.array((a.at - u.bounds[doc]).astype(np.int32))], names=["a", "s", "d", "p"])

    def _read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish documents (kind 0), or emit contents for the shards (1: by anchor, 2: by piece) and set the document
        aside (3)."""
        names = ["kind", "d", *COLUMNS, "a", "first", "o", "content", "text", "gone"]
        for c in chunks(batches):
            u, a, doc = self.anchors(c)
            key = (doc << 32) | (a.at - u.bounds[doc])
            edge = np.zeros(len(u.hashes) + 1, np.int32)
            size, (flat, act) = listed(c.column("asked"), "p", "act")
            owner = np.repeat(np.arange(len(c)), size)
            at = np.searchsorted(key, (owner << 32) | flat)
            named = np.zeros(len(a.at), bool)
            named[at[(act == 1) | (act == 2)]] = True
            gone, sent = (act == 0) & ~named[at], np.flatnonzero(act > 0)
            np.add.at(edge, a.first[at[gone]], 1)
            np.add.at(edge, a.last[at[gone]] + self.window, -1)
            mask = np.cumsum(edge[:-1]) > 0
            d = c.column("d").to_pylist()
            waits = np.zeros(len(c), bool)
            waits[owner[sent]] = True
            rows: list[list] = [[] for _ in names]
            done = u.results(mask, self.text)
            text = c.column("text")
            for i in range(len(c)):
                if not waits[i]:
                    # an unchanged text need not be stored again
                    left = done[i] if self.words or done[i][1] else (*done[i][:-1], None)
                    cells = [0, d[i], *left, None, None, None, None, None, None]
                else:
                    x, y = int(u.bounds[i]), int(u.bounds[i + 1])
                    s, e = runs(mask[x:y])
                    cells = [3, d[i], None, None, None, None, None, None, None, None, None, text[i].as_py(), pack(np.r_[s, e])]
                for col, v in zip(rows, cells, strict=True):
                    col.append(v)
            for j, o in zip(at[sent].tolist(), sent.tolist(), strict=True):
                i = int(owner[o])
                cells = [int(act[o]) % 4, d[i], None, None, None, None, None, int(a.gram[j : j + 1].view(np.int64)[0]), int(a.first[j] - u.bounds[i]), int(a.at[j] - a.first[j]), u.content(int(a.first[j]), int(a.last[j]) + self.window), None, None]
                for col, v in zip(rows, cells, strict=True):
                    col.append(v)
            kinds = [pa.int32(), pa.int64(), *KINDS, pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=names)

    def _units_of(self, content: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        kind = _U if self.words else np.uint8
        width = 8 if self.words else 1
        return np.frombuffer(b"".join(content), kind), np.r_[0, np.cumsum([len(x) // width for x in content])]

    def _shards(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor and order of occurrence: whole anchors are gathered to blocks for the engine."""
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n * 2 * self.window >= SHARD_UNITS:
                whole = pa.concat_batches(held)
                a = whole.column("a").to_numpy()
                cut = int(np.argmax(a == a[-1]))
                if cut:
                    yield from self._blocks(whole.slice(0, cut))
                    held = [whole.slice(cut)]
                    n = whole.num_rows - cut
        if held:
            yield from self._blocks(pa.concat_batches(held))
        give_back()

    def _blocks(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a = rows.column("a").to_numpy()
        step = max(1, SHARD_UNITS // (2 * self.window))
        at = 0
        while at < len(a):
            to = min(len(a), at + step)
            while to < len(a) and a[to] == a[to - 1]:
                to += 1
            block = rows.slice(at, to - at)
            units, bounds = self._units_of(block.column("content").to_pylist())
            group = np.cumsum(np.r_[0, a[at + 1 : to] != a[at : to - 1]])
            hit = self.engine(units, bounds, group, self.window, self.earlier)
            yield self._found(block, hit, bounds)
            at = to

    @staticmethod
    def _found(rows: pa.RecordBatch, hit: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        """Runs of window starts (ascending units of the rows' contents) as (d, start, n)."""
        span = np.searchsorted(bounds, hit, "right") - 1
        head = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (span[1:] != span[:-1])]) if len(hit) else hit
        size = np.diff(np.r_[head, len(hit)])
        hit, span = hit[head], span[head]
        start = rows.column("first").to_numpy()[span] + hit - bounds[span]
        return pa.RecordBatch.from_arrays([rows.column("d").take(pa.array(span)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["d", "start", "n"])

    def _pieces(self, step: int):
        """Pieces of crowded contents (c: first window start, o: the anchor's distance from it): a, the hash of what a piece's
        windows have in common; s, the hash of all its units; p and w, its first window start and its number of windows."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    part = b.slice(at, 2000)
                    units, bounds = self._units_of(part.column("content").to_pylist())
                    u = units if self.words else BYTE_VALUES[units]
                    n = np.diff(bounds) - self.window + 1
                    o = part.column("o").to_numpy().astype(np.int64)
                    high = o // step
                    count = high - (o - n + 1) // step + 1
                    row = np.repeat(np.arange(len(n)), count)
                    cell = high[row] - ranges(np.zeros(len(n), np.int64), count)
                    first = np.maximum(0, o[row] - (cell * step + step - 1))
                    last = np.minimum(n[row] - 1, o[row] - cell * step)
                    core = bounds[row] + o[row] - cell * step
                    a = mix(span_hashes(u, core, core + self.window - step + 1) + cell.astype(_U))
                    s = mix(span_hashes(mix(u), bounds[row] + first, bounds[row] + last + self.window) + (cell * step - o[row] + first).astype(_U))
                    c = part.column("c").to_numpy()[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), part.column("d").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (c + first, last - first + 1, c))],
                        names=["a", "s", "d", "p", "w", "c"],
                    )

        return cut

    def _decided(self, rows: DataFrame, place: list[str]) -> DataFrame:
        """What becomes of the rows (a, s and their `place`: d, p, ...): act 0, all windows are repeated, unless another row
        says otherwise; 1, they are not known to be, and go to a shard of their `a`; 2, the same, but that shard would be crowded;
        5 and 6, they are repeated and go there, too. So only a span's first occurrence needs a row that names it."""
        first = F.min(F.struct(*place)).alias("f")
        # a table of its own, so that the join has a plain exchange on either side and a frequent key's rows can be split
        shared = table(rows.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("s0"), F.max("s").alias("s1"), first).filter("n > 1"))
        seen = rows.join(shared, "a").select("a", "s", *place, (F.col("s0") == F.col("s1")).alias("alone"), F.struct("f.d", "f.p").alias("f"))
        seen = table(seen)
        not_first = (F.col("d") != F.col("f.d")) | (F.col("p") != F.col("f.p"))
        simple = seen.filter("alone")
        simple = (simple.filter(not_first) if self.earlier else simple).select("a", *place, F.lit(0).alias("act"))
        mixed = seen.filter("not alone").select("a", "s", *place)
        spans = table(mixed.groupBy("a", "s").agg(F.count("*").alias("n"), first))
        sizes = table(spans.groupBy("a").agg(F.count("*").alias("m")))
        too = F.lit(0) if self.earlier else F.when(F.col("n") > 1, 4).otherwise(0)
        check = join_frequent(spans.select("a", "n", "f"), sizes, ["a"], "m").select("a", *(f"f.{x}" for x in place), (F.when(F.col("m") > HOT, 2).otherwise(1) + too).alias("act"))
        return simple.unionByName(mixed.select("a", *place, F.lit(0).alias("act"))).unionByName(check)

    def _crowded(self, contents: DataFrame, parts: int) -> DataFrame:
        """Runs of repeated windows (d, start, n) in the contents (d, c, o, content) of crowded anchors."""
        found, width = None, 8 if self.words else 1
        for step in [x for x in STEPS if x == 1 or 5 * x <= self.window]:
            rows = contents.select("d", "c", "o", "content").mapInArrow(self._pieces(step), "a long, s long, d long, p int, w int, c int")
            place = ["d", "p", "w", "c"]
            decided = table(self._decided(rows, place).groupBy("a", *place).agg(F.max("act").alias("act")))
            own = decided.filter("act > 0").join(contents, ["d", "c"])
            piece = F.expr(f"substring(content, (p - c) * {width} + 1, (w - 1 + {self.window}) * {width})")
            own = table(own.select((F.col("act") % 4).alias("act"), "a", "d", F.col("p").alias("first"), F.expr("o - (p - c)").alias("o"), piece.alias("content")))
            more = decided.filter("act in (0, 5, 6)").select("d", F.col("p").alias("start"), F.col("w").alias("n")).unionByName(self._sharded(own.filter("act = 1"), parts))
            found = more if found is None else found.unionByName(more)
            contents = own.filter("act = 2").select("d", F.col("first").alias("c"), "o", "content")
            if contents.isEmpty():
                break
        return found

    def _sharded(self, contents: DataFrame, parts: int) -> DataFrame:
        """Runs of windows (d, start, n) that contents (a, d, first, content) of one `a` share."""
        shard = contents.select("a", "d", "first", "content").repartition(parts, "a").sortWithinPartitions("a", "d", "first")
        return shard.mapInArrow(self._shards, "d long, start int, n int")

    def _finish(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            u = Units(c, self.words)
            edge = np.zeros(len(u.hashes) + 1, np.int32)
            for i, g in enumerate(c.column("gone").to_pylist()):
                x = unpack(g).reshape(2, -1) + u.bounds[i]
                np.add.at(edge, x[0], 1)
                np.add.at(edge, x[1], -1)
            size, (start, n) = listed(c.column("found"), "start", "n")
            start = start + np.repeat(u.bounds[:-1], size)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + n - 1 + self.window, -1)
            done = u.results(np.cumsum(edge[:-1]) > 0, self.text)
            cols = [pa.array([r[k] for r in done], kind) for k, kind in enumerate(KINDS)]
            yield pa.RecordBatch.from_arrays([c.column("d"), *cols], names=["d", *COLUMNS])

    def find(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, n_units, n_removed, n_spans, kept_sha256), a row for each row of `docs`."""
        texts, names = with_keys(docs, id_col, text_col)
        texts = texts.select("d", "text")
        rows = texts.mapInArrow(self._rows, "a long, s long, d long, p int")
        asked = self._decided(rows, ["d", "p"]).drop("a")
        # an entry both removed and checked keeps its two acts
        asked = asked.groupBy("d").agg(F.collect_list(F.struct("p", "act")).alias("asked"))
        read = texts.join(asked, "d", "left").mapInArrow(self._read, f"kind int, d long, {RESULT}, a long, first int, o int, content binary, text string, gone binary")
        read = table(read)
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        found = self._sharded(read.filter("kind = 1"), parts)
        crowded = read.filter("kind = 2").select("d", F.col("first").alias("c"), "o", "content")
        if not crowded.isEmpty():
            found = found.unionByName(self._crowded(crowded, parts))
        found = found.groupBy("d").agg(F.collect_list(F.struct("start", "n")).alias("found"))
        late = read.filter("kind = 3").select("d", "text", "gone").join(found, "d", "left").mapInArrow(self._finish, f"d long, {RESULT}")
        out = read.filter("kind = 0").select("d", *COLUMNS).unionByName(late)
        if self.text and not self.words:
            out = out.join(texts, "d").withColumn("kept_text", F.coalesce("kept_text", "text")).drop("text")
        if names is not None:
            out = names.join(out, "d").drop("d").withColumnRenamed("id", id_col)
        else:
            out = out.select(F.col("d").cast(docs.schema[id_col].dataType).alias(id_col), *COLUMNS)
        return out.select(F.col(f"`{id_col}`"), *(COLUMNS if self.text else COLUMNS[:-1]))
