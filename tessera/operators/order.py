"""Places in a global order without a global sort: rows are cut into ranges at approximate quantiles, and only the ranges' totals,
a fixed number, are added up in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import table

RANGES = 200


def totals_before(rows: DataFrame, value: str, amount: Column | None = None) -> DataFrame:
    """`rows` with `before`: the sum of `amount` (default 1) over the rows with a smaller `value`. Values are unique and not null.

    Rows and their ranges are computed once, as a table: approximate quantiles, and sums of doubles, may come out otherwise when they are
    computed again, and would then not fit the ranges' totals."""
    amount = F.lit(1) if amount is None else amount
    cuts = rows.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 20 * RANGES).alias("cuts"))
    cut = rows.withColumn("_amount", amount).join(F.broadcast(cuts)).withColumn("_part", F.size(F.filter(F.coalesce("cuts", F.array(F.lit(None).cast(rows.schema[value].dataType))), lambda c: c < F.col(value)))).drop("cuts")
    cut = table(cut)
    sizes = cut.groupBy("_part").agg(F.sum("_amount").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(offsets), "_part").withColumn("before", F.col("_base") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return out.select(*rows.columns, "before")


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """`rows` with `name`: the rank of the value from 1 on, ties at the mean of their places.

    The rows are computed once, as a table: they meet their ranks by the value, which must be the same to the last bit."""
    rows = table(rows)
    ties = rows.groupBy(value).agg(F.count("*").alias("_ties"))
    ranked = totals_before(ties, value, F.col("_ties")).select(value, (F.col("before") + (F.col("_ties") + 1) / 2).alias(name))
    return rows.join(ranked, value)


def nth_row(rows: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The row in place `n`, from 1 on, by ascending (value, tie). Approximate quantiles bracket it, so that only the rows between
    them, a ten-thousandth or so, are ordered."""
    total = rows.count()
    if not 1 <= n <= total:
        return rows.limit(0)
    near = [min(1.0, max(0.0, n / total + d)) for d in (-1e-4, 1e-4)]
    low, high = rows.agg(F.percentile_approx(value, near, 20_000)).first()[0]
    below, upto = rows.agg(F.count_if(F.col(value) < low), F.count_if(F.col(value) <= high)).first()
    if below < n <= upto:
        rows, n = rows.filter(F.col(value).between(low, high)), n - below
    return rows.orderBy(value, tie).offset(n - 1).limit(1)


def sorted_runs(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`run(batches, number of the partition)` over the rows in the order of (keys, order), cut into ranges: a key with very many rows lies in
    several partitions, one after another. The result is a table, as ranges may be cut in another way when they are computed again."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    return table(cut.mapInArrow(lambda batches: run(batches, TaskContext.get().partitionId()), schema))


def ends_of_runs(b: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where runs of equal keys end in a batch."""
    if not b.num_rows:
        return []
    new = np.zeros(b.num_rows, bool)
    for k in keys:
        at = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= at[1:] != at[:-1]
    return [*np.flatnonzero(new).tolist(), b.num_rows]


def smoothed(rows: DataFrame, key: str, order: list[str], values: str, keep: float) -> DataFrame:
    """(key, levels): levels that begin at 0 and become keep x level + (1 - keep) x value at each row of the key, after its last row. `values` is
    an array of doubles, of one length everywhere.

    A row maps levels by (x keep, + (1 - keep) value), and such maps compose: each partition of the ordered rows sends one map for each of
    its keys, and those of a key, one a partition at most, are composed in their order. No key's rows are ever together."""
    kind = rows.schema[key].dataType.simpleString()

    def maps(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        held: list = []  # key, scale, level of the last run

        def row(key, scale: float, level: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], kinds[0]), pa.array([part], pa.int64()), pa.array([scale]), pa.array([level.tolist()], pa.list_(pa.float64()))], names=[key_name, "part", "scale", "level"])

        key_name, kinds = key, []
        for b in batches:
            kinds[:] = [b.column(key).type]
            start = 0
            for end in ends_of_runs(b, [key]):
                x = np.array(b.column(values).slice(start, end - start).to_pylist(), "f8")
                weight = keep ** np.arange(len(x) - 1, -1, -1.0)
                name, scale, level = b.column(key)[start].as_py(), keep ** len(x), (1 - keep) * (weight @ x)
                if held and held[0] == name:
                    held = [name, held[1] * scale, held[2] * scale + level]
                else:
                    if held:
                        yield row(*held)
                    held = [name, scale, level]
                start = end
        if held:
            yield row(*held)

    found = sorted_runs(rows.select(key, *order, values), [key], order, maps, f"`{key}` {kind}, part long, scale double, level array<double>")
    all_maps = F.array_sort(F.collect_list(F.struct("part", "scale", "level")))
    start = F.transform(F.element_at(F.collect_list("level"), 1), lambda x: x * 0)
    return found.groupBy(key).agg(F.aggregate(all_maps, start, lambda s, m: F.zip_with(s, m["level"], lambda a, b: a * m["scale"] + b)).alias("levels"))


def running_tail(rows: DataFrame, keys: list[str], order: str, text: str, words: int) -> DataFrame:
    """`rows` (keys, order, text) with `tail`: the last `words` blank-separated words of all texts of the key up to the row, joined as they are.

    A tail is all that later rows need of the past. Partitions of the ordered rows keep their own; one that a key was cut into takes
    up the tails of the key's earlier ones."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (*keys, order)}

    def tails(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        name, tail = None, ""
        for b in batches:
            out, start = [], 0
            texts = b.column(text).to_pylist()
            for end in ends_of_runs(b, keys):
                now = tuple(b.column(k)[start].as_py() for k in keys)
                if now != name:
                    name, tail = now, ""
                for t in texts[start:end]:
                    first, *rest = (tail + (t or "")).rsplit(" ", words)
                    # the blank before the first word stays, so that what comes before it later is not joined to it
                    tail = "".join(f" {x}" for x in rest) if len(rest) == words else " ".join([first, *rest])
                    out.append(tail)
                start = end
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keys, order)), pa.array(np.full(len(out), part, np.int64)), pa.array(out, pa.string())], names=[*keys, order, "part", "tail"])

    found = sorted_runs(rows.select(*keys, order, text), keys, [order], tails, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", part long, tail string")
    spread = Window.partitionBy(*keys)
    last = found.groupBy(*keys, "part").agg(F.max_by("tail", order).alias("last"))
    earlier = F.array_join(F.collect_list("last").over(spread.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), "")
    # keys that were cut: one for each border between two partitions at most
    cut = last.select(*keys, "part", earlier.alias("earlier"), F.count("*").over(spread).alias("parts")).filter("parts > 1").drop("parts")
    cut = cut.select(*(F.col(k).alias(f"_{k}") for k in (*keys, "part")), "earlier")
    same = F.lit(True)
    for k in (*keys, "part"):
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = found.join(F.broadcast(cut), same, "left")
    return joined.select(*keys, order, F.substring_index(F.concat(F.coalesce("earlier", F.lit("")), "tail"), " ", -words).alias("tail"))
