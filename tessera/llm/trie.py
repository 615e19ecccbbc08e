"""Prefix trie of conversations by partition refinement.

A class is the set of conversations that agree in their first d turns: a node of the trie. All conversations begin in one class. Each
round takes a block of further turns (1, 2, 4, ... up to BLOCK of them) of the conversations that are still in a class with others,
and splits the classes turn by turn: a class is named by the SHA-256 digest of its parent's name and its last turn, so a class
needs no join to be named, and a hot class (a first turn that a third of all conversations share) is only ever aggregated. A
conversation that is alone in its class is retired: the rest of its turns is a chain of nodes with one child each, which is written down without
any aggregate. Rounds end when every conversation is alone or has no more turns.

Then the rounds are folded back. Each node stands on the row of its smallest member; a node's subtree is what stands at or below its
depth on its members' rows. So each conversation sums what stands on its rows from the last block to the first, and one aggregate over the
members of every class gives the sums over its subtree. Ids of the conversations that end at a node are sorted over all tasks, joined
to pieces there and then hashed piece by piece, so that a node at which very many end is in no task's memory.

Cases. Rows with a null conv_id take no part. Null role or text counts as empty. Turns are ordered with nulls first; rows of one turn are
ordered by role, then text, and repeated rows are turns of their own. A conversation without turns (possible after rebuilding) is a
member of the root and ends there. An empty table gives no node. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.skew import join_frequent
from tessera.session import table

BLOCK, PIECE = 1 << 12, 1 << 10
ROOT = hashlib.sha256(b"root").digest()
NOTHING = hashlib.sha256(b"").hexdigest()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places from 0 in a sorted partition: (c, part, q, digest, bytes)."""
    part = TaskContext.get().partitionId()
    last, next_q = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column("c").to_numpy()
        at = np.arange(len(c))
        new = np.r_[c[0] != last, c[1:] != c[:-1]]
        start = np.maximum.accumulate(np.where(new, at, -1))
        q = np.where(start < 0, next_q + at, at - start)
        last, next_q = c[-1], int(q[-1]) + 1
        yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(np.full(len(c), part, np.int64)), pa.array(q), b.column("digest"), b.column("bytes")], names=["c", "part", "q", "digest", "bytes"])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(c, p: place from 0, digest of role and text, bytes of the text), with rows ordered over all tasks. A conversation of very many turns is
    cut into ranges; those that lie in several, one a border at most, get the sizes of their earlier ranges by a broadcast."""
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["c", F.asc_nulls_first("turn"), "role", "text"]
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    cut = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = turns.schema["c"].dataType.simpleString()
    rows = table(cut.select("c", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")).mapInArrow(_placed, f"c {kind}, part long, q long, digest binary, bytes long"))
    sizes = rows.groupBy("c", "part").agg(F.count("*").alias("n"))
    spread = Window.partitionBy("c")
    before = spread.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    borders = sizes.select("c", "part", F.count("*").over(spread).alias("parts"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).filter("parts > 1").drop("parts")
    return rows.join(F.broadcast(borders), ["c", "part"], "left").select("c", (F.col("q") + F.coalesce("before", F.lit(0))).alias("p"), "digest", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations of a group of ids share the beginning of the first of them: h turns, by the id's crc32.

    Returns (c, d: depth from 1, digest, bytes) and (c, length)."""
    own = table(numbered_turns(turns))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    convs = own.groupBy("c").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % group)
    sizes = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    convs = table(convs.join(sizes, "base", "left").select("c", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("shared")))
    head = own.filter(F.col("p") < most).select(F.col("c").alias("base"), "p", "digest", "bytes")
    taken = convs.select("c", "h", "base").join(head, "base").filter("p < h").select("c", (F.col("p") + 1).alias("d"), "digest", "bytes")
    # a conversation of very many turns meets its own row here: its turns must not go to one task
    rest = join_frequent(own, convs.select("c", "n", "h", "shared"), ["c"], "n").filter("p >= h").select("c", (F.col("p") + 1 - F.col("h") + F.col("shared")).alias("d"), "digest", "bytes")
    return taken.unionByName(rest), convs.select("c", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the classes along each conversation's block of turns: (c, d, key, parent, bytes, last of the block)."""
    for b in batches:
        c, d, key, parent, size, last = [], [], [], [], [], []
        for who, name, steps in zip(b.column("c").to_pylist(), b.column("key").to_pylist(), b.column("steps").to_pylist(), strict=True):
            for i, step in enumerate(steps, 1):
                below = hashlib.sha256(name + step["digest"]).digest()
                c.append(who)
                d.append(step["d"])
                key.append(below)
                parent.append(name)
                size.append(step["bytes"])
                last.append(i == len(steps))
                name = below
        cols = [pa.array(c, b.column("c").type), pa.array(d, pa.int64()), pa.array(key, pa.binary()), pa.array(parent, pa.binary()), pa.array(size, pa.int64()), pa.array(last, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["c", "d", "key", "parent", "bytes", "last"])


def refine(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split classes until all are single: (rows: a class with others and a member, by round), (nodes: all classes that were met, with
    their number of members and smallest one), (alone: the depth at which a conversation is first alone)."""
    kind = convs.schema["c"].dataType.simpleString()
    n = convs.count()
    root = convs.agg(F.min("c").alias("rep"), F.count("*").alias("n")).filter("n > 0").select(F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), "rep", "n", F.lit(0).cast("long").alias("bytes"))
    start = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    rows, nodes, alone = [start.withColumn("round", F.lit(0))], [root], [convs.select("c", F.lit(0).cast("long").alias("alone")).limit(0 if n != 1 else 1)]
    active, low, size = convs.filter("length > 0").select("c", F.lit(ROOT).alias("key"), "length"), 1, 1
    n = 0 if n == 1 else n
    while n:
        block = turns.filter(F.col("d").between(low, low + size - 1)).join(active.select("c", "key"), "c")
        steps = block.groupBy("c", "key").agg(F.sort_array(F.collect_list(F.struct("d", "digest", "bytes"))).alias("steps"))
        named = table(steps.mapInArrow(_named, f"c {kind}, d long, key binary, parent binary, bytes long, last boolean"))
        met = table(named.groupBy("d", "key").agg(F.first("parent").alias("parent"), F.min("c").alias("rep"), F.count("*").alias("n"), F.first("bytes").alias("bytes")))
        single = met.filter("n = 1").groupBy(F.col("rep").alias("c")).agg(F.min("d").alias("alone"))
        rows.append(named.drop("last").withColumn("round", F.lit(len(rows))))
        nodes.append(met)
        alone.append(single)
        low, size = low + size, min(2 * size, BLOCK)
        going = active.filter(F.col("length") >= low).select("c", "length").join(single, "c", "left_anti")
        active = table(going.join(named.filter("last").select("c", "key"), "c").select("c", "key", "length"))
        n = active.limit(1).count()
    return tuple(reduce(DataFrame.unionByName, parts) for parts in (rows, nodes, alone))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the ids of each key in a sorted partition: (key, first, ids joined by commas)."""
    held: tuple[bytes, list] | None = None
    for b in batches:
        keys, ids = b.column("key").to_pylist(), b.column("c").to_pylist()
        done = []
        for k, c in zip(keys, ids, strict=True):
            if held is None or held[0] != k or len(held[1]) >= 1 << 16:
                if held is not None:
                    done.append(held)
                held = (k, [])
            held[1].append(c)
        if done:
            yield _pieces(done, b.column("c").type)
    if held is not None:
        yield _pieces([held], pa.int64())


def _pieces(done: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([v[0] for _, v in done], pa.int64()), pa.array([",".join(map(str, v)) for _, v in done], pa.string())], names=["key", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, from rows sorted by (key, first)."""
    name, state = None, None
    for b in batches:
        keys, out = [], []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k != name:
                if name is not None:
                    keys.append(name)
                    out.append(state.hexdigest())
                name, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends: SHA-256 of its ids in ascending order, joined by commas) of rows (key, c)."""
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = ends.repartitionByRange(parts, "key", "c").sortWithinPartitions("key", "c").mapInArrow(_joined, "key binary, first long, ids string")
    return pieces.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has (c, d, digest, bytes), every d from 1 to the conversation's length; `convs` has (c, length)."""
    turns, convs = table(turns), table(convs)
    rows, nodes, alone = refine(turns, convs)
    convs = table(convs.join(alone, "c", "left"))
    shared = nodes.filter("n > 1")
    # what stands on its smallest member's row of each shared node; a shared node without children is a leaf there
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.max("rep").alias("_any"))
    core = table(shared.join(children.drop("_any"), "key", "left").fillna(0, ["n_children"]))
    stands = core.select(F.col("rep").alias("c"), "d", ((F.col("n") - 1) * F.col("bytes")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    inner = rows.join(convs.select("c", "alone", "length"), "c").filter("alone is null or d < alone")
    inner = table(inner.join(stands, ["c", "d"], "left").fillna(0, ["saved", "leaf"]))
    # fold back: from a block's last turn to its first, after the sums of the later blocks
    later = Window.partitionBy("c").orderBy(F.desc("round")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = inner.groupBy("c", "round").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.first("alone").alias("alone"))
    carried = blocks.select("c", "round", F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("carry"), (F.sum("leaf").over(Window.partitionBy("c")) + F.when(F.col("alone").isNotNull(), 1).otherwise(0)).alias("leaves"))
    inside = Window.partitionBy("c", "round").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    summed = inner.select("c", "round", "key", F.sum("saved").over(inside).alias("sum")).join(carried, ["c", "round"])
    sums = summed.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum(F.col("sum") + F.col("carry")).alias("saved_tokens"))
    ends = ends_digest(inner.filter("d = length").select("key", F.col("c").cast("long")))
    folded = core.join(sums, "key").join(ends, "key", "left").select("key", "d", "parent", F.col("rep").alias("conv_id"), "n", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
    # chains of single conversations: the first node hangs on a shared one, the others on the node before
    single = nodes.filter("n = 1").join(convs.select(F.col("c").alias("rep"), F.col("alone").alias("d"), "length"), ["rep", "d"])
    here = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    one = lambda d: (F.lit(1).cast("long").alias("n"), F.when(F.col("length") > d, 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("length") > d, NOTHING).otherwise(here).alias("ends_sha256"))
    tops = single.withColumnRenamed("rep", "conv_id").select("key", "d", "parent", "conv_id", *one(F.col("d")))
    hanging = table(folded.unionByName(tops).drop("key"))
    parents = core.select(F.col("key").alias("parent"), F.col("rep").alias("parent_conv_id"), "n_children").filter("n_children > 0").withColumnRenamed("n_children", "_children")
    placed = join_frequent(hanging, parents, ["parent"], "_children").drop("_children").unionByName(hanging.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast(core.schema["rep"].dataType)))
    chains = convs.filter("alone < length").select(F.col("c").alias("conv_id"), "length", F.explode(F.sequence(F.col("alone") + 1, F.col("length"), F.lit(PIECE).cast("long"))).alias("from"))
    chains = chains.repartition(max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "conv_id", "from")
    chains = chains.select("conv_id", "length", F.explode(F.sequence("from", F.least("length", F.col("from") + PIECE - 1))).alias("d")).withColumn("parent_conv_id", F.col("conv_id"))
    chains = chains.select("d", "conv_id", *one(F.col("d")), "parent_conv_id")
    return placed.drop("parent").unionByName(chains).select("conv_id", F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turns = conversations.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).filter("c is not null")
    return prefix_trie(*rebuilt(turns))
