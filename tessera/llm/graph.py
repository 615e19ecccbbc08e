"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import table

JUMPS = 2
SMALL = 200_000  # edges that one task may finish


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of `edges` (a, b): the least id that links reach.

    While there are more than SMALL edges, a round hooks every vertex to its least neighbour, shortens the chains by pointer
    jumping, and contracts the edges to those between different labels. Labels only fall, and a component's least vertex
    keeps its own, so the vertex that is left is the least one. At most SMALL edges, a fixed bound, are then finished by one
    task. Every round's tables go to the shared folder.
    """
    kind = edges.schema["a"].dataType.simpleString()
    e = table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    label = None
    while e.count() > SMALL:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("p"))
        parent = table(parent)
        for _ in range(JUMPS):
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("id", F.col("pp").alias("p"))
        parent = table(parent)
        pa_, pb = parent.select(F.col("id").alias("a"), F.col("p").alias("x")), parent.select(F.col("id").alias("b"), F.col("p").alias("y"))
        e = table(e.join(pa_, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        label = parent if label is None else table(followed(label, parent))
    rest = table(e.coalesce(1).mapInArrow(_finish, f"id {kind}, p {kind}"))
    return (rest if label is None else table(followed(label, rest))).select("id", F.col("p").alias("component"))


def followed(label: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (id, p) with their own labels in `more` put in their place."""
    up = more.select(F.col("id").alias("p"), F.col("p").alias("pp"))
    return label.join(up, "p", "left").select("id", F.coalesce("pp", "p").alias("p"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    a, b = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (0, 1))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    kind = held[0].column(0).type
    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ids[root], kind)], names=["id", "p"])
