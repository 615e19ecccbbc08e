"""Relational operators over DataFrames: writes expressed as new tables, lookups, access, closure."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import table


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `base` with the same keys, the others are added. The last of equal keys in `new`
    is not defined by order, so keys of `new` must be unique."""
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` are added only where their keys are not there yet."""
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").dropDuplicates(keys))


def update_changed(base: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """`column` takes the new value where there is one; `changed` says whether it differs."""
    value = new.select(key, F.col(column).alias("_new"))
    out = base.join(value, key, "left")
    return out.withColumn("changed", F.coalesce(F.col("_new") != F.col(column), F.lit(False))).withColumn(column, F.coalesce("_new", column)).drop("_new")


def anti_join(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return rows.join(done, keys, "left_anti")


def overview(users: DataFrame, projects: DataFrame, user: int, nation: int | None = None) -> DataFrame:
    """A parameterised table function: own and same-nation users with their project counts. An absent parameter adds no
    predicate, so the others still reach the scan."""
    seen = F.col("c_custkey") == user
    if nation is not None:
        seen = seen | (F.col("c_nationkey") == nation)
    counts = projects.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_projects"), F.count_distinct("o_orderstatus").alias("n_states"))
    out = users.filter(seen).select("c_custkey").join(counts, "c_custkey", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") == user).alias("is_owner"), zero("n_projects"), zero("n_states"))


def access_filter(rows: DataFrame, members: DataFrame, key: str, *conditions: Column) -> DataFrame:
    """Rows that meet a condition or whose key is among `members` (distinct keys)."""
    flagged = rows.join(members.select(key, F.lit(True).alias("_member")), key, "left")
    seen = F.coalesce("_member", F.lit(False))
    for c in conditions:
        seen = seen | F.coalesce(c, F.lit(False))
    return flagged.filter(seen).drop("_member")


def nth_tile_labels(score: Column, tiers: Sequence[tuple[float, Sequence[str]]], rest: Sequence[str]) -> list[Column]:
    """Labels of the highest tier whose bound the score reaches."""
    out = []
    for k in range(len(rest)):
        c = F
        for bound, names in tiers:
            c = c.when(score >= bound, names[k])
        out.append(c.otherwise(rest[k]))
    return out


def reconcile(disk: DataFrame, index: DataFrame, key: str, value: str) -> DataFrame:
    """What to do with each key of two states: add, orphan, update or same."""
    a, b = disk.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")), index.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    action = F.when(F.col("_x").isNull(), "add").when(F.col("_y").isNull(), "orphan").when(~F.col("_a").eqNullSafe(F.col("_b")), "update").otherwise("same")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return latest(rows, keys, order, 1)


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each group in a total order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def fill_gaps(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Non-empty old values win; gaps take the new ones."""
    right = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(right, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"))).drop(f"_{c}")
    return out


def tree_closure(folders: DataFrame, root: int) -> DataFrame:
    """All ids below `root` in (id, parent), itself included; cycles end as known ids are not followed again."""
    spark = folders.sparkSession
    known = spark.createDataFrame([(root,)], f"id {folders.schema['id'].dataType.simpleString()}")
    edge = known
    while True:
        edge = table(folders.join(edge.withColumnRenamed("id", "parent"), "parent").select("id").distinct().join(known, "id", "left_anti"))
        if edge.isEmpty():
            break
        known = known.unionByName(edge)
    return known


def group_values(rows: DataFrame, key: str, value: str, how: str = "mean", least: int = 1) -> DataFrame:
    """(key, value): the mean of a group's values, or the `first` one, where all of a group must be equal (an error otherwise). Groups of fewer
    than `least` rows are left out before that, but where no group has more than one row, all rows stay as they are."""
    first, last = F.min(F.struct(value)), F.max(F.struct(value))
    g = rows.groupBy(key).agg(F.count("*").alias("_n"), *([F.avg(value).alias("_out")] if how == "mean" else [first.alias("_low"), last.alias("_high")]))
    single = g.agg(F.max("_n") == 1).first()[0]
    g = g if single else g.filter(F.col("_n") >= least)
    if how == "first":
        message = F.concat(F.lit("a group holds different values: "), F.col(key).cast("string"))
        g = g.withColumn("_out", F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col(f"_low.{value}")).otherwise(F.raise_error(message).cast(rows.schema[value].dataType)))
    elif how != "mean":
        raise ValueError(f"no such way to combine a group: {how}")
    return g.select(key, F.col("_out").alias(value))


GRAMS = 100_000  # grams of needles that may be sent to every task
BLOCK = 1 << 16  # bytes of texts that are looked at together
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray, at: int = 0) -> np.ndarray:
    """The 8 bytes from each place of `data` on as a number, from `at` to where 8 are left."""
    return np.ndarray(len(data) - 7 - at, "<u8", data, at, (1,))


class _Grams:
    """Some strings, and where they stand in the texts of an Arrow array, in one pass over its bytes for most strings: 8 bytes at each place
    are looked up, and only where they begin a string the rest is. Shorter strings take a pass for each length in bytes.

    Up to 8 bytes are compared as numbers. Longer strings go by a number made of theirs, so that another string may pass for one: whoever
    asks compares what is found."""

    def __init__(self, grams: list[str]):
        coded = [g.encode("utf-8", "surrogatepass") for g in grams]
        self.strings = pa.array(grams, pa.string())
        self.empty = [i for i, c in enumerate(coded) if not c]
        self.longest = max(map(len, coded), default=0)
        self.passes = []
        for size in range(1, 9):
            tables, begins = [], []
            for n in sorted({len(c) for c in coded if min(len(c), 8) == size}):
                which = np.array([i for i, c in enumerate(coded) if len(c) == n])
                data = np.frombuffer(b"".join(coded[i] for i in which) + bytes(8), np.uint8)
                at = np.arange(len(which)) * n
                keys = self.keys(_words(data), at, n)
                begins.append(_words(data)[at] & self.mask(size))
                order = np.argsort(keys, kind="stable")
                tables.append((n, keys[order], which[order], *self.slots(keys)))
            if tables:
                self.passes.append((self.mask(size), *self.slots(np.concatenate(begins)), tables))

    @staticmethod
    def mask(size: int) -> np.uint64:
        return np.uint64((1 << 8 * size) - 1)

    @staticmethod
    def slots(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        """A table that rules most other numbers out by their first bits, once multiplied, and how many bits are dropped."""
        bits = max(12, (16 * len(keys)).bit_length())
        out = np.zeros(1 << bits, bool)
        out[keys * _ODD >> np.uint64(64 - bits)] = True
        return out, np.uint64(64 - bits)

    def keys(self, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """A number for the n bytes from some places on."""
        if n <= 8:
            return words[at] & self.mask(n)
        out = words[at]
        for further in [*range(8, n - 8, 8), n - 8]:
            out = (out ^ out >> np.uint64(29)) * _ODD + words[at + further]
        return out

    def held(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and strings that meet, each pair once."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(ends[-1] - ends[0])
        data = np.zeros(size + self.longest + 8, np.uint8)
        if size:
            data[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends, words = ends - ends[0], _words(data)
        pairs = [np.arange(len(texts)) * len(self.strings) + i for i in self.empty]
        for mask, slots, shift, tables in self.passes:
            for low in range(0, size, BLOCK):
                block = words[low : min(size, low + BLOCK)] & mask
                np.multiply(block, _ODD, out=block)
                np.right_shift(block, shift, out=block)
                at = np.flatnonzero(slots[block.view(np.int64)]) + low
                for n, keys, which, own, drop in tables:
                    key = self.keys(words, at, n)
                    likely = own[key * _ODD >> drop]
                    key, place = key[likely], at[likely]
                    row = np.searchsorted(ends, place, "right") - 1
                    inside = place + n <= ends[row + 1]
                    key, row = key[inside], row[inside]
                    left, right = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    # two strings with one number are both found
                    for k in range(int((right - left).max(initial=0))):
                        met = left + k < right
                        pairs.append(np.unique(row[met] * len(self.strings) + which[left[met] + k]))
        return np.divmod(np.unique(np.concatenate(pairs or [np.zeros(0, np.int64)])), max(1, len(self.strings)))


def containment_pairs(hays: DataFrame, needles: DataFrame, size: int = 5) -> DataFrame:
    """(hay, needle) of two columns of distinct strings, where the hay holds the needle anywhere.

    A needle's grams of `size` characters (of all of it, if it is shorter) stand in whatever holds it, so the one of them in the
    fewest hays names the candidates, and only those are compared. The empty needle stands in every hay; nulls in none."""
    hays = table(hays.filter("hay is not null").select("hay", F.monotonically_increasing_id().alias("h")))
    longest = hays.agg(F.max(F.length("hay"))).first()[0]
    needles = table(needles.filter(F.length("needle") <= F.lit(longest)).select("needle", F.monotonically_increasing_id().alias("x")))
    wanted = needles.withColumn("k", F.least(F.lit(size), F.length("needle")))
    sizes = sorted(r[0] for r in wanted.select("k").distinct().collect())  # `size` + 1 numbers at most

    def grams(text: Column, k: int) -> Column:
        # a pattern that only looks ahead finds overlapping grams in one pass over the text; none begins inside a character of two units
        return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?!\p{{Cs}})(?=(.{{{k}}}))"), F.lit(1))) if k else F.array(F.lit(""))

    def every(text: Column, k: Column | None) -> Column:
        """Grams of one size, that of `k`, or of all sizes."""
        if k is None:
            return F.concat(*(grams(text, n) for n in sizes)) if sizes else F.array().cast("array<string>")
        out = F.lit(None).cast("array<string>")
        for n in sizes:
            out = F.when(k == n, grams(text, n)).otherwise(out)
        return out

    wanted = table(wanted.select("x", F.explode(every(F.col("needle"), F.col("k"))).alias("gram")))

    def postings(grams: DataFrame) -> DataFrame:
        """(h, gram) of some grams; few of them go to the texts, so that others never leave one."""
        some = [r[0] for r in grams.limit(GRAMS + 1).collect()]
        if len(some) > GRAMS:
            return hays.select("h", F.explode(every(F.col("hay"), None)).alias("gram")).join(grams, "gram", "left_semi")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Grams(some)
            for batch in batches:
                row, gram = known.held(batch.column(1))
                yield pa.record_batch([batch.column(0).take(pa.array(row)), known.strings.take(pa.array(gram))], ["h", "gram"])

        return hays.select("h", "hay").mapInArrow(look, "h long, gram string")

    # first the counts, which tasks sum before they are shuffled; then the places of the rarest grams alone
    often = postings(wanted.select("gram").distinct()).groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no hay has rules the needle out
    rare = wanted.join(often, "gram", "left").groupBy("x").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).filter("m.n > 0")
    rare = table(rare.select("x", F.col("m.gram").alias("gram")))
    met = rare.join(postings(rare.select("gram").distinct()), "gram").select("x", "h")
    return met.join(needles, "x").join(hays, "h").filter(F.contains("hay", "needle")).select("hay", "needle")
