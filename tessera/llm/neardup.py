"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document's set holds its distinct shingles of `size` words (ASCII letters folded); a document with fewer words has one
shingle of all. Documents with equal sets are one class, and only a class's least id takes part further on.

Forest: each of TREES sorted orders of the classes is by DEPTH values of the signature. Neighbours in an order are
candidates by their longest common prefix: the orders are range-partitioned, so equal prefixes of any number spread over
tasks. A region of classes with a common prefix of LEAST_DEPTH values becomes candidates pair by pair while it holds at
most REGION classes; a larger one is split by its next value, and so on; direct neighbours with a common prefix of
LEAST_DEPTH always are candidates. Candidates whose signatures agree far too little for the threshold (SLACK) are left out.
Ties of a key are in another hashed order in each tree.

Crowded classes, those of larger regions (or of regions that a partition's edge cuts), get an exact second pass over full sets,
once the links of the first are known (`crowded_links`). It looks for links between components only, and makes no pairs of a
group: shingles that few crowded classes hold name pairs to confirm; sets that agree in shingles of many classes alone are
first thinned out (those that cannot reach the threshold so, equal ones, and those that their component's fullest set stands
for), and what is left of them, little as a rule, is counted in blocks that share shingles and sizes.

Confirmation: of its candidates, each class first verifies the most alike one with a smaller id; the links found merge
classes into components. All candidates that still lie in different components are then verified too. So every pair of
candidates is either verified or already connected.

Recall: a pair of similarity 0.75 meets in a given tree at depth 3 with probability 0.42, in 16 trees with 0.9998 (measured
against brute force in tests/llm).

Cases. Null and empty texts, and texts without words, have the empty set: linked with nothing, component their own id.
Rows with a null id are linked with nothing, with a null component, and kept. Repeated rows share their component. An empty
table gives an empty one. Texts of any length are used whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.graph import components, followed
from tessera.llm.text import NOT_BLANK, chunks, give_back, mix, ranges, rolling, span_hashes, word_hashes, word_spans
from tessera.session import table

TREES, DEPTH, LEAST_DEPTH, REGION = 16, 6, 3, 8
COMPARED = 64  # signature values that candidates are compared on
SLACK = 0.22  # of agreement below the threshold: 4 standard errors of COMPARED values
RARE = 16  # crowded classes that hold a rare shingle, at most
BLOCK_CLASSES, BLOCK_SHINGLES, COLUMNS = 512, 1 << 17, 2048  # of a block of crowded classes, about; shingles counted at a time
_U = np.uint64
MULTIPLIERS = mix(np.arange(1, TREES * DEPTH + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, one document after another, and n+1 bounds."""
    starts, ends, first = word_spans(data, off, NOT_BLANK)
    h = word_hashes(data, starts, ends, fold=True)
    n = np.diff(first)
    full = np.maximum(n - size + 1, 0)
    grams = rolling(h, size)
    long = grams[ranges(first[:-1][full > 0], full[full > 0])] if len(grams) else np.zeros(0, _U)
    short = np.flatnonzero((n > 0) & (n < size))
    values = np.concatenate([long, span_hashes(h, first[:-1][short], first[1:][short])])
    doc = np.concatenate([np.repeat(np.arange(len(n)), full), short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One byte for each MinHash value; rows of documents with an empty set are 0."""
    n = len(bounds) - 1
    out = np.zeros((n, len(MULTIPLIERS)), np.uint8)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for k, m in enumerate(MULTIPLIERS):
            out[some, k] = mix(np.minimum.reduceat(values * m, bounds[some])) & _U(255)
    return out


def _signed(size: int, text_col: str):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, text_col):
            values, bounds = shingle_sets(c.data, c.off, size)
            sig = signatures(values, bounds)
            one, two = (np.r_[_U(0), np.cumsum(mix(values ^ _U(x)))] for x in (0x1234567, 0x7654321))
            both = [pa.array((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64)) for x in (one, two)]
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(sig.shape[1]), len(sig), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([c.column("id"), pa.array(np.diff(bounds)), *both, cells], names=["id", "n", "h1", "h2", "sig"])

    return sign


def neighbours(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs in sorted (tree, key) rows: all pairs of small regions and direct neighbours; some rows are carried
    from batch to batch. Members of larger regions, and of those at either end of the rows, are named as pairs with
    themselves."""

    def pairs(b: pa.RecordBatch, head: bool, tail: bool) -> pa.RecordBatch | None:
        n = b.num_rows
        tree = b.column("tree").to_numpy()
        mat = lambda name, w: np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint8).reshape(n, w)
        key, sig, ids = mat("key", DEPTH), mat("sig", COMPARED), b.column("id")
        same = np.cumprod(key[1:] == key[:-1], axis=1).sum(1) * (tree[1:] == tree[:-1])
        size = np.zeros((DEPTH + 1, n), np.int64)
        for d in range(LEAST_DEPTH, DEPTH + 1):
            run = np.r_[0, np.cumsum(same < d)]
            size[d] = np.bincount(run)[run]
        run = np.r_[0, np.cumsum(same < LEAST_DEPTH)]
        dense = size[LEAST_DEPTH] > REGION
        dense |= (head & (run == 0)) | (tail & (run == run[-1]))
        out_i, out_j, out_e = [], [], []
        lcp = same
        for o in range(1, min(REGION + 1, n)):
            if o > 1:
                lcp = np.minimum(lcp[:-1], same[o - 1 :])
            i = np.flatnonzero(lcp >= LEAST_DEPTH)
            if not len(i):
                break
            alike = (sig[i] == sig[i + o]).mean(1)
            take = ((size[lcp[i], i] <= REGION) | (o == 1)) & (alike >= least)
            out_i.append(i[take])
            out_j.append(i[take] + o)
            out_e.append(alike[take])
        itself = np.flatnonzero(dense)
        i, j = np.concatenate([itself, *out_i]), np.concatenate([itself, *out_j])
        if len(i):
            return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(np.concatenate([np.ones(len(itself)), *out_e]), pa.float64())], names=["a", "b", "alike"])

    carry, held, head = None, None, True
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            if out := pairs(held, head, False):
                yield out
            carry, head = held.slice(max(0, held.num_rows - REGION - 1)), head and held.num_rows <= REGION
        held = b if carry is None else pa.concat_batches([carry, b])
    if held is not None and (out := pairs(held, head, True)):
        yield out
    give_back()


def _sets(size: int, text_col: str):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, text_col):
            values, bounds = shingle_sets(c.data, c.off, size)
            yield pa.RecordBatch.from_arrays([c.column("id"), pa.array([values[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["id", "s"])

    return sets


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])
        give_back()

    return confirm


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column("n").to_numpy()
        values = np.frombuffer(b"".join(b.column("s").to_pylist()), np.int64)
        at = pa.array(np.repeat(np.arange(len(n)), n))
        for x in range(0, len(values), 1 << 16):
            part = at.slice(x, 1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(values[x : x + (1 << 16)]), *(b.column(c).take(part) for c in ("id", "label", "n"))], names=["h", "id", "label", "n"])


def _parted(percent: int):
    """The shingles that other labels hold, too, as rare ones with their places in the order of the whole set, as far as a first
    common shingle may stand, and common ones in that order, if they may suffice for a link."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rare, common, tops = [], [], []
            for n, t in zip(b.column("n").to_pylist(), b.column("t"), strict=True):
                h, df = (t.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.lexsort((h, df))
                h, df = h[order], df[order]
                place = n - len(h) + 1 + np.arange(len(h))
                need = -(-percent * n // 100)
                few = np.flatnonzero((df <= RARE) & (place <= n - need + 1))
                rare.append([{"h": x, "k": k} for x, k in zip(h[few].tolist(), place[few].tolist(), strict=True)])
                many = h[df > RARE]
                common.append(many.tobytes() if len(many) >= need else None)
                tops.append(int(h[-1]) if len(h) else 0)
            kind = pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("n"), pa.array(rare, kind), pa.array(common, pa.binary()), pa.array(tops, pa.int64())], names=["id", "label", "n", "rare", "common", "top"])

    return part


def _not_stood_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose common shingles are not all held by their label's fullest set (`best`, of `best_n` shingles, no more than theirs)."""
    for b in batches:
        keep = []
        for i, n, c, own, m, best in zip(*(b.column(x).to_pylist() for x in ("id", "n", "common", "best_id", "best_n", "best")), strict=True):
            keep.append(i == own or m > n or not np.isin(np.frombuffer(c, np.int64), np.frombuffer(best, np.int64)).all())
        yield b.filter(pa.array(keep, pa.bool_())).select(["id", "label", "n", "common", "top"])


def _heads(percent: int):
    """The first common shingles of each set, one of which any partner holds among its own first ones."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, n = b.column("common").to_pylist(), b.column("n").to_numpy()
            size = np.array([len(c) // 8 for c in cells], np.int64)
            take = size + percent * -n // 100 + 1  # size - ceil(percent * n / 100) + 1
            values = [np.frombuffer(c, np.int64)[:k] for c, k in zip(cells, take.tolist(), strict=True)]
            at = pa.array(np.repeat(np.arange(len(n)), take))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)), *(b.column(c).take(at) for c in ("id", "label", "n", "most", "block"))], names=["h", "id", "label", "n", "most", "block"])

    return head


def _between_blocks(percent: int):
    """Links by common shingles between classes of different labels in one pair of blocks (x, y), one for each pair of
    labels."""

    def links(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, block = t.column("id"), t.column("block").to_numpy()
        label = t.column("label").combine_chunks().dictionary_encode()
        label = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
        left, right = (np.flatnonzero(block == t.column(c)[0].as_py()) for c in ("x", "y"))
        cells, n = t.column("common").to_pylist(), t.column("n").to_numpy()
        values = np.frombuffer(b"".join(cells), _U)
        owner = np.repeat(np.arange(len(n)), [len(c) // 8 for c in cells])
        _, word = np.unique(values, return_inverse=True)
        spot = np.full((2, len(n)), -1)
        spot[0, left], spot[1, right] = np.arange(len(left)), np.arange(len(right))
        sides = []
        for k in (0, 1):
            mine = spot[k, owner] >= 0
            sides.append((word[mine], spot[k, owner[mine]]))
        size = int(word.max()) + 1
        df = [np.bincount(w, minlength=size) for w, _ in sides]
        both = np.flatnonzero((df[0] > 0) & (df[1] > 0))
        column = np.full(size, -1)
        column[both] = np.arange(len(both))
        sides = [(c[c >= 0], r[c >= 0]) for c, r in ((column[w], r) for w, r in sides)]
        sides = [(c[o], r[o]) for c, r in sides for o in [np.argsort(c, kind="stable")]]
        common = np.zeros((len(left), len(right)), np.float32)
        for x in range(0, len(both), COLUMNS):
            parts = []
            for (c, r), m in zip(sides, (len(left), len(right)), strict=True):
                lo, hi = np.searchsorted(c, [x, x + COLUMNS])
                cell = np.zeros((m, min(COLUMNS, len(both) - x)), np.float32)
                cell[r[lo:hi], c[lo:hi] - x] = 1
                parts.append(cell)
            common += parts[0] @ parts[1].T
        common = common.astype(np.int64)
        ok = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
        i, j = np.nonzero(ok & (label[left][:, None] != label[right][None, :]))
        i, j = left[i], right[j]
        _, at = np.unique(np.minimum(label[i], label[j]).astype(np.int64) * (len(n) + 1) + np.maximum(label[i], label[j]), return_index=True)
        return pa.table({"a": ids.take(pa.array(i[at])), "b": ids.take(pa.array(j[at]))})

    return links


def crowded_links(crowded: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components (`label`) of all pairs of `crowded` (id, label, s: the full set) that reach the
    threshold: exact.

    Shingles are in one order: those of a single label first, then by the classes that hold them. Two sets that reach the
    threshold have their first common shingle among the first n - ceil(n * percent / 100) + 1 of both, and the smaller one among
    its first n - ceil(2 * percent * n / (100 + percent)) + 1. Either that shingle is rare: it names at most RARE * RARE pairs,
    which are confirmed. Or all that they share are common ones, and these alone reach the threshold: then a set whose common
    shingles are among those of another set of its label that is no larger can be left out, as that one links with all that it
    would link with; and a set of n shingles, m of them common, has partners of at most m * (100 + percent) / percent - n."""
    kind = crowded.schema["id"].dataType.simpleString()
    docs = table(crowded.select("id", "label", F.floor(F.length("s") / 8).cast("long").alias("n"), "s"))
    shingles = docs.mapInArrow(_exploded, f"h long, id {kind}, label {kind}, n long")
    across = F.min("label") != F.max("label")
    shared = shingles.groupBy("h").agg(F.count("*").alias("df"), across.alias("across")).filter("across").select("h", "df")
    held = shingles.join(shared, "h").groupBy("id", "label", "n").agg(F.collect_list(F.struct("h", "df")).alias("t"))
    parted = table(held.mapInArrow(_parted(percent), f"id {kind}, label {kind}, n long, rare array<struct<h: long, k: long>>, common binary, top long"))

    rare = parted.select("id", "label", "n", F.explode("rare").alias("r")).select("r.h", "r.k", "id", "label", "n")
    x = rare.select("h", F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("k").alias("ka"))
    y = rare.select("h", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))
    smaller = "la <> lb and (na < nb or (na = nb and a < b)) and 100 * na >= {p} * nb and ka <= na - ceil(2 * {p} * na / {q}) + 1"
    met = x.join(y, "h").filter(smaller.format(p=percent, q=100 + percent)).select("a", "b").distinct()
    s = docs.select("id", "s")
    met = met.join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    links = table(met.mapInArrow(_confirmed(percent), f"a {kind}, b {kind}"))

    full = parted.filter("common is not null").groupBy("label", "common").agg(F.min(F.struct("n", "id", "top")).alias("m")).select("label", "common", "m.n", "m.id", "m.top")
    full = table(full)
    best = full.groupBy("label").agg(F.max_by(F.struct("id", "n", "common"), F.struct(F.length("common"), -F.col("n"), "id")).alias("m"))
    best = best.select("label", F.col("m.id").alias("best_id"), F.col("m.n").alias("best_n"), F.col("m.common").alias("best"))
    left = full.join(best, "label").mapInArrow(_not_stood_for, f"id {kind}, label {kind}, n long, common binary, top long")
    left = table(left.withColumn("most", F.expr(f"length(common) div 8 * {100 + percent} div {percent} - n")))
    # blocks: sets of one most frequent shingle, cut by size and by hash where they are many
    bins = left.groupBy("top", F.floor(F.log("n") * 32).alias("bin")).agg(F.count("*").alias("c"), F.sum(F.length("common") / 8).alias("w"))
    whole = Window.partitionBy("top")
    bins = bins.withColumn("small", (F.sum("c").over(whole) <= BLOCK_CLASSES) & (F.sum("w").over(whole) <= BLOCK_SHINGLES))
    bins = bins.select("top", "bin", "small", F.ceil(F.greatest(F.col("c") / BLOCK_CLASSES, F.col("w") / BLOCK_SHINGLES)).alias("cuts"))
    placed = left.withColumn("bin", F.floor(F.log("n") * 32)).join(bins, ["top", "bin"])
    block = F.when(F.col("small"), F.xxhash64("top")).otherwise(F.xxhash64("top", "bin", F.pmod(F.xxhash64("id"), F.col("cuts"))))
    placed = table(placed.select("id", "label", "n", "common", "most", block.alias("block")))
    first = table(placed.mapInArrow(_heads(percent), f"h long, id {kind}, label {kind}, n long, most long, block long"))
    there = first.groupBy("h", "block").agg(F.min("n").alias("n0"), F.max("most").alias("n1"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    there = there.groupBy("h").agg(F.collect_list(F.struct("block", "n0", "n1", "l0", "l1")).alias("there"), (F.min("l0") != F.max("l1")).alias("across")).filter("across").select("h", "there")
    fits = F.filter("there", lambda o: (o["n0"] <= F.col("most")) & (o["n1"] >= F.col("n")) & ((o["l0"] != F.col("label")) | (o["l1"] != F.col("label"))))
    goes = first.join(there, "h").select("id", F.explode(F.transform(fits, lambda o: o["block"])).alias("other")).distinct()
    goes = goes.join(placed, "id").select("id", "label", "n", "common", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return links.unionByName(table(goes.groupBy("x", "y").applyInArrow(_between_blocks(percent), f"a {kind}, b {kind}")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach), kept (id = component_id)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = table(texts.mapInArrow(_signed(size, "text"), f"id {kind}, n long, h1 long, h2 long, sig binary"))
    classes = table(signed.filter("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "sig")).alias("m"), F.count("*").alias("copies")).select("h1", "h2", "copies", "m.id", "m.sig"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    trees = classes.select("id", "sig", F.substring("sig", 1, COMPARED).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trees = trees.select("tree", F.expr(f"substring(sig, tree * {DEPTH} + 1, {DEPTH})").alias("key"), F.xxhash64("id", "tree").alias("tie"), "id", F.col("s").alias("sig"))
    order = trees.repartitionByRange(parts, "tree", "key", "tie").sortWithinPartitions("tree", "key", "tie")
    near = order.mapInArrow(lambda batches: neighbours(batches, max(0.0, percent / 100 - SLACK)), f"a {kind}, b {kind}, alike double")
    first = table(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "alike").groupBy("a", "b").agg(F.max("alike").alias("alike")))
    pairs, dense = first.filter("a <> b"), first.filter("a = b").select(F.col("a").alias("id"))
    ends = first.select(F.col("a").alias("id")).unionByName(first.select(F.col("b").alias("id"))).distinct()
    sets = table(texts.join(ends.hint("shuffle_hash"), "id", "left_semi").mapInArrow(_sets(size, "text"), f"id {kind}, s binary"))

    def confirmed(some: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        return table(some.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_confirmed(percent), f"a {kind}, b {kind}"))

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a"))
    links = confirmed(best)
    found = components(links)
    label = lambda c, name: found.select(F.col("id").alias(c), F.col("component").alias(name))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(label("a", "ca"), "a", "left").join(label("b", "cb"), "b", "left")
    rest = rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    labelled = classes.select("id", "sig").join(dense, "id", "left_semi").join(found.select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = confirmed(rest.select("a", "b")).unionByName(crowded_links(labelled.join(sets, "id"), percent)).distinct()
    if not more.isEmpty():
        # the further links join components, so only their labels are linked anew
        joined = more.join(label("a", "ca"), "a", "left").join(label("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        later = components(joined)
        known = found.select("id", F.col("component").alias("p"))
        new = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id"))).distinct().join(known, "id", "left_anti").select("id", F.col("id").alias("p"))
        found = table(followed(known.unionByName(new), later.select("id", F.col("component").alias("p"))).select("id", F.col("p").alias("component")))
    reps = classes.join(found, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    out = signed.select("id", "n", "h1", "h2").join(reps, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
