"""Hard negatives: for each anchor and each of its positives, the best rows of other labels below the positive's score.

Components become integers, floor(scale * x), so a score (the inner product with the anchor) is an integer and ties are exact. The
rows are dealt into blocks of candidates and the anchors into blocks of anchors; a cell holds one of each, at most about CANDIDATES
and ANCHORS rows, and meets every candidate with every anchor once. Two passes over the cells:

1. each anchor's scores with the candidates of its own label are sorted in full by (score descending, id); the first `positives` of
   every cell are merged to the first `positives` of all;
2. each anchor's scores with the candidates of other labels are sorted in the same way. The upper limit of each positive (its own
   score) is found by binary search, and from there the first `negatives` entries that reach the lower limit, `low` hundredths
   of the positive's score, are read; those of all cells are merged.

A merge keeps a few rows a cell and drops the rest before they are shuffled, so an anchor's scores are never together anywhere.

Cases. Rows with a null label, a null vector, or any null or non-finite component take no part; nor do rows whose integer vector
has a norm of 2**31 or more, whose scores may not fit a long. Only vectors of one length meet; empty vectors score 0. A null id is no
anchor and comes last among ties. Rows that repeat an id are rows of their own: each can be an anchor, a positive or a negative.
A positive without such negatives (one of a negative score, for instance) has no rows. An empty table gives an empty one; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import table

CANDIDATES, ANCHORS, TILE = 1 << 15, 1 << 11, 1 << 20
EXACT, MOST = 2.0**26, 2.0**31


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by floating point where norms prove that no sum is rounded, else by Python's integers."""
    wide_a, wide_b = (np.sqrt((x * x).sum(1)) >= EXACT for x in (a, b))
    with np.errstate(all="ignore"):
        out = np.rint(np.where(wide_a[:, None], 0, a) @ np.where(wide_b[:, None], 0, b).T).astype(np.int64)
    if not (wide_a.any() or wide_b.any()):
        return out
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    out = out.astype(object)
    if a.shape[1]:
        out[wide_a] = whole(a[wide_a]).dot(whole(b).T)
        out[:, wide_b] = whole(a).dot(whole(b[wide_b]).T)
    return out


def sorted_scores(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of a, order of b, negated scores in that order) for each row of a. Rows of b stand in the order of their ids, so a
    stable sort by score is a sort by (score, id)."""
    step = max(1, TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        falling = -scores(a[at : at + step], b)
        order = np.argsort(falling, axis=1, kind="stable")
        falling = np.take_along_axis(falling, order, 1)
        for i in range(len(order)):
            yield at + i, order[i], falling[i]


def by_length(cells: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    size = np.array([len(x) for x in cells], np.int64)
    return {n: (at, np.frombuffer(b"".join([cells[i] for i in at.tolist()]), "f4" if n % 8 == 4 else "f8").reshape(len(at), -1)) for n in np.unique(size).tolist() for at in [np.flatnonzero(size == n)]}


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `anchors` is a condition on the column `id`."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    label_kind = vectors.schema[label_col].dataType.simpleString()

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for v in b.column("v"):
                x = v.values.to_numpy(zero_copy_only=False).astype("f8") if v.is_valid else np.full(1, np.nan)
                with np.errstate(all="ignore"):
                    x = np.floor(scale * x)
                    out.append(x.tobytes() if np.isfinite(x).all() and np.sqrt((x * x).sum()) < MOST else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(out, pa.binary())], names=["id", "label", "v"])

    plain = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v")).filter("label is not null and v is not null")
    usable = plain.mapInArrow(integers, f"id {kind}, label {label_kind}, v binary").filter("v is not null")
    rows = table(usable.withColumn("node", F.monotonically_increasing_id()).withColumn("anchor", F.coalesce(anchors, F.lit(False))))
    n, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    high = max(1, -(-n_anchors // ANCHORS))
    wide = max(1, -(-n // CANDIDATES), min(-(-tasks // high), n // 256))
    own = lambda k: F.pmod(F.xxhash64("node"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    candidates = rows.select("id", "label", "v", "node", own(wide).alias("i"), every(high).alias("j"))

    def met(asking: DataFrame, search, schema: str) -> DataFrame:
        """`search(anchors, candidates)` over every cell."""
        asked = asking.select("*", every(wide).alias("i"), own(high).alias("j"))
        return asked.groupBy("i", "j").cogroup(candidates.groupBy("i", "j")).applyInArrow(search, schema)

    def pairs(left: pa.Table, right: pa.Table, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each label and length: anchors' rows and vectors, then those of the candidates that have that label, or another."""
        labels = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks], left.schema.field("label").type).combine_chunks().dictionary_encode().indices.to_numpy()
        mine, theirs = labels[: len(left)], labels[len(left) :]
        there = by_length(right.column("v").to_pylist())
        for size, (at, a) in by_length(left.column("v").to_pylist()).items():
            if size not in there:
                continue
            to, b = there[size]
            for label in np.unique(mine[at]).tolist():
                x, y = mine[at] == label, (theirs[to] == label) == same
                if y.any():
                    yield at[x], a[x], to[y], b[y]

    def in_order(right: pa.Table) -> pa.Table:
        return right.sort_by([("id", "ascending"), ("node", "ascending")])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        right = in_order(right)
        who, node = left.column("node").to_numpy(), right.column("node").to_numpy()
        a, p, s = [], [], []
        for at, x, to, y in pairs(left, right, True):
            for i, order, falling in sorted_scores(x, y):
                me = who[at[i]]
                first = [k for k in range(min(len(order), positives + 1)) if node[to[order[k]]] != me][:positives]
                a += [me] * len(first)
                p += to[order[first]].tolist()
                s += [-int(v) for v in falling[first]]
        found = right.select(["id", "node"]).take(pa.array(p, pa.int64()))
        return pa.table([pa.array(a, pa.int64()), found.column("id"), found.column("node"), pa.array(s, pa.int64())], names=["a", "id", "node", "score"])

    def merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        """The first k of each key by (score descending, id)."""
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "node")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    asking = rows.filter("anchor").select("id", "label", "v", "node")
    first = merged(met(asking, nearest, f"a long, id {kind}, node long, score long"), ["a"], positives)
    best = first.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    ready = asking.join(best, asking["node"] == best["a"]).select("id", "label", "v", "node", F.col("positives.id").alias("positive"), F.col("positives.score").alias("limit"))

    def below(left: pa.Table, right: pa.Table) -> pa.Table:
        right = in_order(right)
        limits = left.column("limit").to_pylist()
        rank, p, q, s = [], [], [], []
        for at, x, to, y in pairs(left, right, False):
            for i, order, falling in sorted_scores(x, y):
                me = int(at[i])
                for k, limit in enumerate(limits[me]):
                    start = int(np.searchsorted(falling, -limit, "left"))
                    for v, c in zip(falling[start : start + negatives].tolist(), order[start : start + negatives].tolist(), strict=True):
                        if -100 * v < low * limit:
                            break
                        rank.append(k)
                        p.append(me)
                        q.append(int(to[c]))
                        s.append(-v)
        anchor, negative = left.take(pa.array(p, pa.int64())), right.take(pa.array(q, pa.int64()))
        ids = left.column("positive").to_pylist()
        positive = pa.array([ids[i][k] for i, k in zip(p, rank, strict=True)], left.schema.field("positive").type.value_type)
        limit = pa.array([limits[i][k] for i, k in zip(p, rank, strict=True)], pa.int64())
        return pa.table([anchor.column("node"), pa.array(rank, pa.int32()), anchor.column("id"), positive, limit, negative.column("id"), negative.column("node"), pa.array(s, pa.int64())], names=["a", "k", "anchor_id", "positive_id", "positive_score", "id", "node", "score"])

    found = met(table(ready), below, f"a long, k int, anchor_id {kind}, positive_id {kind}, positive_score long, id {kind}, node long, score long")
    return merged(found, ["a", "k"], negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
