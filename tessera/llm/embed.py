"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables, reranked with the vectors.

Learning (on a bounded sample, `sample` vectors of each of the LENGTHS most frequent lengths, the least by a hash of their id; vectors of
other lengths keep their own axes): the leading principal
directions, then a rotation that alternates between binary codes and the orthogonal matrix that fits them best. A vector's
code holds the signs of its rotated, centred coordinates.

Blocks: the vectors of a label and length are dealt by hash into as many groups as their bytes need, each of about SHARE, and every two
groups (and each with itself) meet in a block. A vector is sent once for each group of its label, never for the codes it looks up:
those are some hundreds, and stay in the task. Labels of less than a SMALL-th of a group share blocks, and the label is part of the code.

Retrieval: in a block the code is cut into TABLES substrings, each with a table of one group. Two unit vectors with cosine >= c are
at most 2 - 2c apart in squared distance, so in one substring at most a TABLES-th of it; bits that differ there must have
coordinates whose squares sum to no more. So a vector of the other group looks up, besides its own substring, every substring
that flips bits within that limit. All pairs at the threshold meet: the retrieval is exact, not approximate (recall 1 up to
rounding).

Rerank: TILE vectors with near codes are compared with all that any of them found by matrix product, in single precision with a margin
for its rounding, and what is left in double precision. A pair is compared once. A block returns for each vector the number of
its links and its root in the block, never pairs. Equal vectors of a label are one class with a count and a number of its own, which
stands for it in all joins: ids may repeat.

Cases. Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or id, link
with nothing (component: their id). Vectors of different lengths never link. Rows that repeat an id are vectors of
their own, each with its own links, whether their vectors are equal or not. An empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.session import table

TABLES, MOST_BITS, ROUNDS, LENGTHS = 4, 64, 30, 16
SHARE, SMALL, MOST_PARTS = 1 << 24, 64, 2000  # bytes of a group's vectors
TILE, EDGES = 32, 1 << 20  # vectors compared at once; edges held until they are contracted


class Quantiser:
    """Centre and rotation for vectors of one length."""

    def __init__(self, sample: np.ndarray):
        n, dim = sample.shape
        bits = min(MOST_BITS, dim)
        self.mean = sample.mean(0) if n else np.zeros(dim)
        if n < 2:
            self.turn = np.eye(dim)[:, :bits]
        else:
            x = sample - self.mean
            basis = np.linalg.svd(x.T @ x)[0][:, :bits]
            v = x @ basis
            r = np.linalg.qr(np.random.default_rng(5).normal(size=(bits, bits)))[0]
            for _ in range(ROUNDS):
                a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (a @ b).T
            self.turn = basis @ r
        self.parts = [p for p in np.array_split(np.arange(bits), TABLES) if len(p)]

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        return ((unit - self.mean) @ self.turn).astype("f4")


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def probes(z: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row, flipped code) whose flipped coordinates' squares sum to at most `limit`; no flip first."""
    row, total = np.arange(len(z)), np.zeros(len(z))
    code = (z > 0) @ (1 << np.arange(z.shape[1], dtype=np.int64))
    square = z.astype("f8") ** 2
    for j in range(z.shape[1]):
        more = total + square[row, j]
        ok = more <= limit
        row, code, total = np.r_[row, row[ok]], np.r_[code, code[ok] ^ (1 << j)], np.r_[total, more[ok]]
    return row, code


def local_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's component in a block, from roots so far and more edges."""
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class Group:
    """Vectors of one length in the order of label and first substring, their rotated coordinates, and a table for each substring: members
    by their cells, the cells, and where each begins. A cell is a label's number and a code."""

    def __init__(self, rows: pa.Table, kind: str, quantiser: Quantiser):
        self.node, self.copies, self.label = (rows.column(c).to_numpy() for c in ("node", "copies", "label"))
        self.raw = np.frombuffer(b"".join(rows.column("v").to_pylist()), kind).reshape(rows.num_rows, -1)
        self.parts, self.tables = quantiser.parts, []
        sort = np.argsort(self.cells(quantiser.rotated(unit_rows(self.raw.astype("f8"))), self.parts[0]), kind="stable")
        self.node, self.copies, self.label, self.raw = (x[sort] for x in (self.node, self.copies, self.label, self.raw))
        self.labels = len(np.unique(self.label))
        unit = self.unit(slice(None))
        self.z, self.single = quantiser.rotated(unit), unit.astype("f4")
        for part in self.parts:
            cell = self.cells(self.z, part)
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])
            self.tables.append((order, cell[order][first], np.r_[first, len(cell)]))

    def cells(self, z: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (self.label << len(part)) + (z[:, part] > 0) @ (1 << np.arange(len(part)))

    def unit(self, at: np.ndarray | slice) -> np.ndarray:
        return unit_rows(self.raw[at].astype("f8"))

    def found_by(self, z: np.ndarray, label: np.ndarray, limit: float) -> np.ndarray:
        """All members that agree with any of these vectors in the label and a substring, up to flips within `limit`."""
        found = np.zeros(len(self.raw), bool)
        for part, (order, cells, first) in zip(self.parts, self.tables, strict=True):
            row, code = probes(z[:, part], limit)
            if self.labels == 1:
                wanted = np.zeros(1 << len(part), bool)
                wanted[code[label[row] == self.label[0]]] = True
                at = np.flatnonzero(wanted[cells & ((1 << len(part)) - 1)])
            else:
                code += label[row] << len(part)
                at = np.minimum(np.searchsorted(cells, code), len(cells) - 1)
                at = np.unique(at[cells[at] == code])
            n = first[at + 1] - first[at]
            found[order[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return np.flatnonzero(found)


def linked_in_block(x: Group, y: Group | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, number of links, root) of the vectors that have links between two groups, or in one if there is no other."""
    own, y = y is None, x if y is None else y
    base = 0 if own else len(x.node)
    node, copies = (x.node, x.copies) if own else (np.r_[x.node, y.node], np.r_[x.copies, y.copies])
    limit = (2 - 2 * cosine) / len(x.parts) * (1 + 1e-4) + 1e-9  # coordinates are rounded to single precision
    low = cosine - 1e-6 - 2e-7 * x.raw.shape[1]
    links, root, ends, held = np.zeros(len(node), np.int64), np.arange(len(node)), [], 0
    for since in range(0, len(x.node), TILE):
        tile = slice(since, since + TILE)
        other = y.found_by(x.z[tile], x.label[tile], limit)
        if own:
            other = other[other > since]
        other = other[(x.single[tile] @ y.single[other].T >= low).any(0)]
        link = (x.unit(tile) @ y.unit(other).T >= cosine) & (x.label[tile, None] == y.label[other])
        mine = np.arange(since, since + len(link))
        if own:
            link &= mine[:, None] < other
        some = link.any(0)
        if not some.any():
            continue
        other, link = base + other[some], link[:, some]
        links[mine] += link @ copies[other]
        links[other] += copies[mine] @ link
        # the tile's vectors that share a neighbour, and each neighbour with one of its own
        near = link.astype("f4")
        a, b = np.nonzero(near @ near.T)
        ends += [(mine[a], mine[b]), (other, mine[link.argmax(0)])]
        held += len(a) + len(other)
        if held > EDGES:
            root = local_roots(root, *map(np.concatenate, zip(*ends, strict=True)))
            ends, held = [], 0
    if ends:
        root = local_roots(root, *map(np.concatenate, zip(*ends, strict=True)))
    some = np.flatnonzero(links)
    return node[some], links[some], node[root[some]]


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id (least id that links reach), kept (id = component_id)."""
    spark = vectors.sparkSession
    id_kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, width = ("f4", 4) if single else ("f8", 8)

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column("v"):
                x = v.values.to_numpy(zero_copy_only=False).astype("f8") if v.is_valid else np.zeros(0)
                with np.errstate(over="ignore"):
                    ok = len(x) and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
                out.append(x.astype(kind).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(out, pa.binary())], names=["id", "label", "v"])

    plain = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    rows = plain.mapInArrow(usable, f"id {id_kind}, label {label_kind}, v binary").withColumn("h", F.when(F.col("v").isNotNull() & F.col("id").isNotNull() & F.col("label").isNotNull(), F.unhex(F.md5("v"))))
    classes = rows.filter("h is not null").groupBy("label", "h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = table(classes.withColumn("node", F.monotonically_increasing_id()))
    lengths = [r[0] for r in classes.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(LENGTHS).collect()]
    models: dict[int, Quantiser] = {}
    for n in lengths:
        some = classes.filter(F.length("v") == n)
        share = min(1.0, 1.1 * sample / max(1, some.count()))
        if share < 1:
            some = some.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        got = some.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
        models[n // width] = Quantiser(unit_rows(np.array([np.frombuffer(r[0], kind) for r in got]).astype("f8")))

    # large labels are few: each has more than a SMALL-th of a group
    sized = classes.withColumn("n", F.length("v"))
    sizes = sized.groupBy("label", "n").agg(F.sum("n").alias("bytes"))
    large = F.col("bytes") * SMALL > SHARE
    groups = F.ceil(F.col("bytes") / SHARE).cast("int")
    blocks, rest = sizes.agg(F.sum(F.when(large, groups * (groups + 1) / 2)), F.sum(F.when(~large, F.col("bytes")))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shared = max(4 * parts, math.ceil((rest or 0) / SHARE))
    dealt = sized.join(F.broadcast(sizes.filter(large).select("label", "n", groups.alias("groups"))), ["label", "n"], "left")
    hashed = F.xxhash64("label")
    dealt = dealt.withColumn("of", F.when(F.col("groups").isNull(), F.pmod(hashed, F.lit(shared))).otherwise(hashed)).withColumn("groups", F.coalesce("groups", F.lit(1)))
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = dealt.select("n", "of", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), (F.col("g") < F.col("o")).alias("first"), "label", "node", "copies", "v")
    block = ["n", "of", "i", "j"]
    dealt = dealt.repartition(max(parts, min(MOST_PARTS, int(4 * (blocks or 0)) + (shared if rest else 0))), *block)

    def compare(rows: pa.Table) -> pa.Table:
        dim = rows.column("n")[0].as_py() // width
        quantiser = models.get(dim) or Quantiser(np.zeros((0, dim)))
        number = rows.column("label").combine_chunks().dictionary_encode().indices.cast(pa.int64())
        rows = rows.set_column(rows.column_names.index("label"), "label", number)
        both = [part for part in (rows.filter(rows.column("first")), rows.filter(pc.invert(rows.column("first")))) if part.num_rows]
        one_group = rows.column("i")[0] == rows.column("j")[0]
        if rows.num_rows < 2 or not one_group and len(both) < 2:
            out = np.zeros((3, 0), np.int64)
        else:
            x, *y = (Group(part, kind, quantiser) for part in both)
            out = linked_in_block(x, y[0] if y else None, cosine)
        return pa.Table.from_arrays([pa.array(c) for c in out], names=["a", "n", "b"])

    linked = table(dealt.groupBy(*block).applyInArrow(compare, "a long, n long, b long"))
    counts = linked.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    group = components(linked.select("a", "b")).withColumnRenamed("id", "node")
    reps = classes.select("label", "h", "node", "id", "copies").join(counts, "node", "left").join(group, "node", "left").filter("n is not null or copies > 1")
    reps = table(reps.select("label", "h", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.col("component").alias("group")))
    # groups are named by the number of a class: their least id is the component
    least = reps.filter("group is not null").groupBy("group").agg(F.min("id").alias("component"))
    reps = reps.join(least, "group", "left").select("label", "h", "n", F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "label", "h").join(reps, ["label", "h"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
