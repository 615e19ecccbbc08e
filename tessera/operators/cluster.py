"""Complete linkage on sparse distance lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected
from tessera.session import table

EDGES = 100_000  # pairs of a component that one task joins to the end
STEPS = 4  # joint steps over tasks before components are looked at again


def linkage(ids: list, close: dict[tuple, float], most: float) -> list[int]:
    """Cluster of each id, by the place of its first member: the two clusters whose furthest members are closest are joined while
    that is below `most`; the first of equals. Pairs that `close` (distances) does not hold are too far apart.

    Chains of nearest neighbours: each cluster points at its nearest one, and two that point at each other are joined. A join never brings
    a cluster nearer to a third than the nearer of its parts was, so whoever is joined, the result is the same."""
    place = {v: k for k, v in enumerate(ids)}
    near: list[dict[int, float]] = [{} for _ in ids]
    for (a, b), d in close.items():
        if d < most and a != b:
            i, j = place[a], place[b]
            near[i][j] = near[j][i] = d
    owner = list(range(len(ids)))
    chain: list[int] = []
    for start in range(len(ids)):
        if owner[start] != start:
            continue
        chain = [start]
        while chain:
            i = chain[-1]
            if not near[i]:
                chain.pop()
                continue
            j = min(near[i], key=lambda k, i=i: (near[i][k], min(i, k), max(i, k)))
            if len(chain) < 2 or chain[-2] != j:
                chain.append(j)
                continue
            del chain[-2:]
            i, j = min(i, j), max(i, j)
            one, two = near[i], near[j]
            for k in one.keys() | two.keys():
                near[k].pop(i, None)
                near[k].pop(j, None)
            near[j] = {}
            near[i] = {k: max(one[k], two[k]) for k in one.keys() & two.keys()}
            for k, d in near[i].items():
                near[k][i] = d
            owner[j] = i
            if not chain:
                chain = [i]
    for k in range(len(owner)):
        root = k
        while owner[root] != root:
            root = owner[root]
        owner[k] = root
    return owner


def joint_step(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join all pairs of clusters that are nearest to each other at once: (pairs of the clusters then, (old, new) names).

    `near` is (a, b, d) with a < b. Two new clusters are as far apart as their furthest parts, and too far if a pair of parts is missing."""
    ways = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    least = ways.groupBy("a").agg(F.min(F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("m"))
    joined = table(least.groupBy("m.lo", "m.hi").agg(F.count("*").alias("n")).filter("n = 2").select(F.col("hi").alias("old"), F.col("lo").alias("new")))
    named = lambda df, c: df.join(joined.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    moved = named(named(near, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
    pairs = moved.groupBy("a", "b").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    parts = joined.select(F.col("new").alias("c"), F.lit(2).alias("parts"))
    for c in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("c").alias(c), F.col("parts").alias(f"_{c}")), c, "left")
    whole = F.coalesce("_a", F.lit(1)) * F.coalesce("_b", F.lit(1))
    return table(pairs.filter(F.col("n") == whole).select("a", "b", "d")), joined


def complete_linkage(pairs: DataFrame, most: float) -> DataFrame:
    """(id, cluster) of every id in `pairs` (a, b, c: cosine) that has another within reach: complete linkage by 1 - c, joined below `most`;
    a cluster is named by its least id, and of equal distances the pair with the lesser names is joined first.

    Members of a cluster are all closer than `most`, so a cluster lies inside one component of the pairs that are. Components of at most
    EDGES pairs are joined to the end in a task each; larger ones take joint steps over all tasks, which leave ever fewer pairs,
    until they are no larger than that."""
    kind = pairs.schema["a"].dataType.simpleString()
    close = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (1 - F.col("c")).alias("d")).filter((F.col("d") < most) & (F.col("a") != F.col("b")))
    near = table(close.groupBy("a", "b").agg(F.max("d").alias("d")))
    names = near.select(F.col("a").alias("id")).union(near.select("b")).distinct().withColumn("cluster", F.col("id"))
    renamed = lambda names, change: names.join(change.select(F.col("old").alias("cluster"), "new"), "cluster", "left").select("id", F.coalesce("new", "cluster").alias("cluster"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*pdf.a, *pdf.b})
        owner = linkage(ids, dict(zip(zip(pdf.a, pdf.b, strict=True), pdf.d, strict=True)), most)
        return pd.DataFrame({"old": ids, "new": [ids[k] for k in owner]})

    while True:
        component = near.join(connected(near.select("a", "b")).select(F.col("id").alias("a"), "component"), "a")
        sizes = component.groupBy("component").agg(F.count("*").alias("n"))
        sized = table(component.join(sizes, "component"))
        done = sized.filter(F.col("n") <= EDGES).select("component", "a", "b", "d").groupBy("component").applyInPandas(lambda pdf: cluster(pdf), f"old {kind}, new {kind}")
        names = table(renamed(names, done))
        near = sized.filter(F.col("n") > EDGES).select("a", "b", "d")
        if near.isEmpty():
            return names
        for _ in range(STEPS):
            near, joined = joint_step(near)
            names = renamed(names, joined)
