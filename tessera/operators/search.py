"""Exact inner-product search and ranks over all candidates, with bounds that rule whole buckets out.

A candidate goes to the nearest of at most PIVOTS pivots (some candidates; which ones only matters for speed) and to one of TILES ranges of its norm:
a bucket. A bucket's summary is its size, its largest norm and its largest distance r to its pivot p. For a query q every x
in it has q.p - |q| r <= q.x <= min(q.p + |q| r, |q| max|x|). There are PIVOTS x TILES summaries of three numbers at most, at any number
of candidates, and they go to every task; candidates and queries only meet by shuffles, in cells of at most about ROWS candidates and
QUERIES queries of one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import table

PIVOTS, TILES, ROWS, QUERIES, TILE = 32, 4, 1 << 13, 1 << 13, 1 << 21
#: Scores closer than this are equal: sums of products may be rounded in another order.
SAME = 1e-12


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), "f8").reshape(len(cells), -1)


def packed(rows: DataFrame, by_norm: bool) -> DataFrame:
    """(id, v: doubles, norm) of rows (id, vec) without nulls; unit vectors with `by_norm`, where a vector without a direction is left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.asarray(v, "f8") for v in b.column("vec").to_pylist()]
            norm = np.array([np.sqrt((v * v).sum()) for v in x])
            keep = np.flatnonzero(norm > 0) if by_norm else np.arange(len(x))
            v = [(x[i] / norm[i] if by_norm else x[i]).tobytes() for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep)), pa.array(v, pa.binary()), pa.array(np.ones(len(keep)) if by_norm else norm[keep])], names=["id", "v", "norm"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "vec").filter("id is not null and vec is not null").mapInArrow(pack, f"id {kind}, v binary, norm double")


class Summaries:
    """What tasks know of all buckets."""

    def __init__(self, pivots: np.ndarray, tiles: int, found: list):
        self.bucket = np.array([r["bucket"] for r in found], np.int64)
        self.centre = pivots[self.bucket // tiles]
        self.size, self.norm, self.away = (np.array([r[c] for r in found], "f8") for c in ("n", "norm", "away"))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of each query in each bucket, widened by what rounding may do."""
        middle = q @ self.centre.T
        reach = np.sqrt((q * q).sum(1))[:, None]
        slack = SAME + 1e-9 * reach * np.maximum(self.norm, self.away)
        return middle - reach * self.away - slack, np.minimum(middle + reach * self.away, reach * self.norm) + slack


class Buckets:
    """Candidates (id, vec) in buckets: `rows` (bucket, sub, id, v), and the summaries."""

    def __init__(self, candidates: DataFrame, by_norm: bool = False):
        rows = table(packed(candidates, by_norm))
        self.kind = rows.schema["id"].dataType.simpleString()
        few = min(PIVOTS, max(1, rows.count() // (ROWS // 32)))
        some = rows.orderBy(F.xxhash64("id"), "id").limit(few).select("v").collect()
        pivots = np.array([np.frombuffer(r[0]) for r in some]) if some else np.zeros((0, 1))
        tiles = 1 if by_norm else TILES
        cuts = np.array(rows.agg(F.percentile_approx("norm", [k / tiles for k in range(1, tiles)])).first()[0] or [], "f8") if tiles > 1 else np.zeros(0)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, norm = matrix(b.column("v")), b.column("norm").to_numpy()
                if not len(v):
                    continue
                # squared distances but for |v|**2; the distance to the pivot that is taken is computed without cancellation
                near = ((pivots * pivots).sum(1) - 2 * (v @ pivots.T)).argmin(1)
                bucket = near * tiles + np.searchsorted(cuts, norm, "right")
                away = np.sqrt(((v - pivots[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(b.column(c) for c in ("id", "v", "norm")), pa.array(away)], names=["bucket", "id", "v", "norm", "away"])

        placed = table(rows.mapInArrow(place, f"bucket int, id {self.kind}, v binary, norm double, away double"))
        found = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("away").alias("away")).orderBy("bucket").collect()
        self.summaries = Summaries(pivots, tiles, found)
        subs = F.element_at(F.create_map(*(F.lit(int(x)) for r in found for x in (r["bucket"], -(-r["n"] // ROWS)))), F.col("bucket")) if found else F.lit(1)
        self.rows = placed.select("bucket", F.pmod(F.xxhash64("id", "v"), subs).cast("int").alias("sub"), "id", "v")

    def meet(self, asked: DataFrame, search: Callable, schema: str) -> DataFrame:
        """`search(queries, candidates)` over every cell that `asked` (bucket, query columns) names."""
        parts = asked.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        # one row a bucket: bounded like the summaries
        here = self.rows.join(F.broadcast(parts), "bucket")
        candidates = here.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        subs = self.rows.groupBy("bucket").agg(F.max("sub").alias("subs"))
        mine = asked.join(F.broadcast(parts), "bucket").join(F.broadcast(subs), "bucket")
        mine = mine.withColumn("part", F.pmod(F.xxhash64("q", "v"), F.col("parts")).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs")))).drop("parts", "subs")
        key = ["bucket", "sub", "part"]
        return mine.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(search, schema)


def ask(queries: DataFrame, wanted: Callable, schema: str) -> DataFrame:
    """Rows (bucket, ...) of queries: `wanted` gives, for a batch, the rows and the buckets that they go to."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, bucket = wanted(b)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(c.take(pa.array(row)) for c in b.columns)], names=["bucket", *b.schema.names])

    return queries.mapInArrow(send, f"bucket int, {schema}")


def blocks(left: pa.Table, right: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of some rows of `left` with all of `right`, at most about TILE at once."""
    if not len(left) or not len(right):
        return
    x, y = matrix(left.column("v")), matrix(right.column("v"))
    step = max(1, TILE // len(y))
    for at in range(0, len(x), step):
        yield slice(at, min(len(x), at + step)), x[at : at + step] @ y.T


def top_products(queries: DataFrame, candidates: DataFrame, k: int = 1) -> DataFrame:
    """(q, id, score, rank, compared): the k candidates with the largest inner products of each query, the lesser id first among equals, and
    how many candidates the query was compared with. Both sides are (id, vec), ids of queries are unique; a query does not find its own id.

    The bucket with the best bound is searched first; what it yields rules out every bucket whose bound is below that."""
    b = Buckets(candidates)
    known, kind = b.summaries, b.kind
    own = table(packed(queries, False).select(F.col("id").alias("q"), "v"))

    def best(batch: pa.RecordBatch) -> np.ndarray:
        return known.bounds(matrix(batch.column("v")))[1]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        q, found = right.column("id").combine_chunks(), {"q": [], "id": [], "score": [], "compared": []}
        mine = left.column("q").to_pylist() if len(left) else []
        place = {v: i for i, v in enumerate(q.to_pylist())}
        for rows, s in blocks(left, right):
            for i, line in zip(range(rows.start, rows.stop), s, strict=True):
                if mine[i] in place:
                    line[place[mine[i]]] = -np.inf
                top = np.argsort(-line, kind="stable")[: k]
                top = top[line[top] > -np.inf]
                found["q"] += [mine[i]] * (len(top) + 1)
                found["id"] += [*q.take(pa.array(top)).to_pylist(), None]
                found["score"] += [*line[top].tolist(), None]
                found["compared"] += [0] * len(top) + [len(right)]
        return pa.table({"q": pa.array(found["q"], left.schema.field("q").type), "id": pa.array(found["id"], right.schema.field("id").type), "score": pa.array(found["score"], pa.float64()), "compared": pa.array(found["compared"], pa.int64())})

    out = f"q {kind}, id {kind}, score double, compared long"
    if not len(known.bucket):
        return candidates.sparkSession.createDataFrame([], f"q {kind}, id {kind}, score double, rank int, compared long")
    first = table(b.meet(ask(own, lambda x: (np.arange(x.num_rows), known.bucket[best(x).argmax(1)]), f"q {kind}, v binary"), search, out))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = lambda df: df.filter("id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    least = ranked(first).groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))

    def others(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bound = best(batch)
        least = batch.column("least").to_numpy(zero_copy_only=False).astype("f8")
        go = bound >= np.where(np.isnan(least), -np.inf, least)[:, None]
        go[np.arange(len(bound)), bound.argmax(1)] = False
        row, at = np.nonzero(go)
        return row, known.bucket[at]

    more = b.meet(ask(own.join(least, "q", "left"), others, f"q {kind}, v binary, least double"), search, out)
    both = table(first.unionByName(more))
    return ranked(both.drop("compared")).join(both.groupBy("q").agg(F.sum("compared").alias("compared")), "q").select("q", "id", "score", "rank", "compared")


def product_ranks(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rank of each query's own candidate by inner product over the candidate's norm: (id, greater, not_less, compared), the numbers of other
    candidates that score above it and at least as high, and how many it was compared with. Both sides are (id, vec), with unique ids.

    A bucket whose least possible score is above the own one counts whole, one whose largest is below it counts nothing; only
    candidates of the others are compared."""
    b = Buckets(candidates, by_norm=True)
    known, kind = b.summaries, b.kind
    mine = packed(queries, False)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                v = matrix(x.column("v"))
                yield pa.RecordBatch.from_arrays([x.column("q"), x.column("v"), pa.array((v * matrix(x.column("w"))).sum(1))], names=["q", "v", "own"])

    asked = mine.join(b.rows.select("id", F.col("v").alias("w")), "id").select(F.col("id").alias("q"), "v", "w")
    asked = table(asked.mapInArrow(scored, f"q {kind}, v binary, own double"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                n = ((known.bounds(matrix(x.column("v")))[0] > x.column("own").to_numpy()[:, None]) @ known.size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([x.column("q"), pa.array(n), pa.array(n), pa.array(np.zeros(len(n), np.int64))], names=["q", "greater", "not_less", "compared"])

    def between(x: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        low, high = known.bounds(matrix(x.column("v")))
        own = x.column("own").to_numpy()[:, None]
        row, at = np.nonzero((low <= own) & (high >= own))
        return row, known.bucket[at]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        above, least = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        place = {v: i for i, v in enumerate(right.column("id").to_pylist())}
        names, own = left.column("q").to_pylist(), left.column("own").to_numpy()
        for rows, s in blocks(left, right):
            for i in range(rows.start, rows.stop):
                if names[i] in place:
                    s[i - rows.start, place[names[i]]] = -np.inf
            mark = own[rows][:, None]
            above[rows] = (s > mark + SAME).sum(1)
            least[rows] = (s >= mark - SAME).sum(1)
        return pa.table({"q": left.column("q"), "greater": above, "not_less": least, "compared": np.full(len(left), len(right), np.int64)})

    out = f"q {kind}, greater long, not_less long, compared long"
    counts = asked.mapInArrow(whole, out).unionByName(b.meet(ask(asked, between, f"q {kind}, v binary, own double"), count, out))
    return counts.groupBy(F.col("q").alias("id")).agg(*(F.sum(c).alias(c) for c in ("greater", "not_less", "compared")))
