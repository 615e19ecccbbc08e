"""Joins and windows over intervals in timelines.

A range join on a timeline alone compares every pair of it. Here both sides are cut into cells of `cell` seconds and
joined on (timeline, cell); a pair is reported in the first cell that holds both, so no distinct is needed and a busy timeline
spreads over its cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators import offsets

EPS = 1e-8


def _cells(start: Column, stop: Column, cell: float) -> Column:
    return F.sequence(F.floor(start / cell), F.floor(F.greatest(start, stop) / cell))


def range_join(windows: DataFrame, events: DataFrame, condition: Column, cell: float, how: str = "inner") -> DataFrame:
    """Pairs of windows (timeline, w_start, w_stop, ...) and events (timeline, start, stop, ...) that meet `condition`,
    which must imply that the closed intervals touch."""
    w = windows.withColumn("_c", F.explode(_cells(F.col("w_start"), F.col("w_stop"), cell))).withColumn("_w0", F.floor(F.col("w_start") / cell))
    e = events.withColumn("_c", F.explode(_cells(F.col("start"), F.col("stop"), cell))).withColumn("_e0", F.floor(F.col("start") / cell))
    return w.join(e, ["timeline", "_c"]).filter((F.col("_c") == F.greatest("_w0", "_e0")) & condition).drop("_c", "_w0", "_e0")


def overlaps() -> Column:
    """Open overlap: touching intervals do not count."""
    return (F.col("start") < F.col("w_stop")) & (F.col("stop") > F.col("w_start"))


def enclosed() -> Column:
    return (F.col("start") >= F.col("w_start")) & (F.col("stop") <= F.col("w_stop"))


def starts_ends_or_spans() -> Column:
    """The point-query form: an event that starts in the window, ends in it, or spans it; an empty event at the window's
    start counts."""
    s, e, a, b = F.col("start"), F.col("stop"), F.col("w_start"), F.col("w_stop")
    return ((s >= a) & (s < b)) | ((e > a) & (e <= b)) | ((s <= a) & (e >= b))


def nearest(points: DataFrame, frames: DataFrame, tolerance: float) -> DataFrame:
    """For each point (timeline, point_id, t) the frame (timeline, frame_id, ft) nearest in time within the tolerance; the
    lesser frame_id wins a tie. Points without one stay, with nulls."""
    p = points.withColumn("_c", F.explode(F.sequence(F.floor((F.col("t") - tolerance) / tolerance), F.floor((F.col("t") + tolerance) / tolerance))))
    f = frames.withColumn("_c", F.floor(F.col("ft") / tolerance))
    near = p.join(f, ["timeline", "_c"]).withColumn("dist", F.abs(F.col("ft") - F.col("t"))).filter(F.col("dist") <= tolerance)
    best = near.groupBy("point_id").agg(F.min(F.struct("dist", "frame_id")).alias("_b")).select("point_id", "_b.frame_id", "_b.dist")
    return points.join(best, "point_id", "left")


def strided_windows(rows: DataFrame, stride: float, duration: float, drop_incomplete: bool = True) -> DataFrame:
    """Windows of `duration` each `stride` from start to stop of each row."""
    stop = F.col("stop") - duration if drop_incomplete else F.col("stop")
    n = F.ceil((stop + EPS - F.col("start")) / stride)
    every = rows.withColumn("k", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<bigint>"))))
    return every.withColumn("w_start", F.col("start") + F.col("k") * stride).withColumn("w_stop", F.col("w_start") + duration)


def chunk_events(events: DataFrame, longest: float, shortest: float) -> DataFrame:
    """Events longer than `longest` cut into pieces of that length; a rest shorter than `shortest` is dropped."""
    n = F.greatest(F.ceil(F.col("duration") / longest), F.lit(1))
    cut = events.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("offset", F.col("piece") * longest)
    cut = cut.withColumn("length", F.least(F.lit(longest), F.col("duration") - F.col("offset")))
    return cut.filter((F.col("length") >= shortest) | (F.col("piece") == 0))


def beside(rows: DataFrame, value: Column, cell: float, ahead: bool = False) -> DataFrame:
    """`rows` (timeline, start, event_id, ...) with `_near`: `value` of the row before in the timeline (or after, with `ahead`), null for the
    first (last). A timeline is cut into cells of time: rows look inside their cell, and only what stands at a cell's
    border is looked up among the cells, so a timeline that holds most of the rows spreads over tasks."""
    step, pick, order = (F.lead, F.min_by, ["start", "event_id"]) if ahead else (F.lag, F.max_by, ["start", "event_id"])
    inside = Window.partitionBy("timeline", "_cell").orderBy(*order)
    r = rows.withColumn("_cell", F.floor(F.col("start") / cell)).withColumn("_value", value)
    cells = r.groupBy("timeline", "_cell").agg(pick("_value", F.struct(*order)).alias("_value"))
    carry = cells.select("timeline", "_cell", step("_value").over(Window.partitionBy("timeline").orderBy("_cell")).alias("_near"))
    r = r.withColumn("_near", step("_value").over(inside)).withColumn("_inner", step(F.lit(True)).over(inside))
    border = r.filter("_inner is null").drop("_near").join(carry, ["timeline", "_cell"])
    return r.filter("_inner").unionByName(border).drop("_cell", "_value", "_inner")


def split_breaks(used: DataFrame, longest: float | None = None, cell: float = 86_400.0) -> DataFrame:
    """(timeline, t): where the split of a timeline's events (timeline, event_id, start, stop, split) changes, in the order of their starts, and
    each `longest` seconds from there to the end of the last event of the section. Two null splits are equal."""
    b = beside(used, F.struct("split", "stop"), cell)
    first = b.filter(F.col("_near").isNull() | ~F.col("_near.split").eqNullSafe(F.col("split"))).select("timeline", "event_id", "start", F.col("_near.stop").alias("before"))
    if longest is None:
        return first.select("timeline", F.col("start").alias("t"))
    ended = beside(first, F.struct("before"), cell, ahead=True)
    last = used.groupBy("timeline").agg(F.max_by("stop", F.struct("start", "event_id")).alias("_end"))
    inner = ended.filter("_near is not null").withColumn("_end", F.col("_near.before"))
    sections = inner.unionByName(ended.filter("_near is null").join(last, "timeline")).withColumn("n", F.ceil((F.col("_end") - F.col("start")) / longest))
    return sections.filter("n > 0").select("timeline", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("timeline", (F.col("start") + F.col("k") * longest).alias("t"))


def even_breaks(events: DataFrame, longest: float, shortest: float | None = None) -> DataFrame:
    """(timeline, t): each `longest` seconds from a timeline's first start to its last stop, but for a last one with less than
    `shortest` behind it."""
    span = events.groupBy("timeline").agg(F.min("start").alias("since"), F.max("stop").alias("until")).withColumn("n", F.ceil((F.col("until") - F.col("since")) / longest))
    if shortest is not None:
        rest = F.col("until") - (F.col("since") + (F.col("n") - 1) * longest)
        span = span.withColumn("n", F.col("n") - F.when(rest < shortest, 1).otherwise(0))
    return span.filter("n > 0").select("timeline", "since", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("timeline", (F.col("since") + F.col("k") * longest).alias("t"))


def cut_events(events: DataFrame, breaks: DataFrame, shortest: float | None = None, cell: float = 3600.0) -> DataFrame:
    """Pieces of events (timeline, event_id, start, stop, ...) between the breaks (timeline, t) inside them: piece (from 0), offset in the event,
    start, duration, stop. A break that leaves less than `shortest` to one of its neighbours, or to an end of the event, does
    not count; neighbours are taken before any is left out. An event without breaks is its only piece."""
    w = events.select("timeline", "event_id", F.col("start").alias("w_start"), F.col("stop").alias("w_stop"))
    t = breaks.select("timeline", F.col("t").alias("start"), F.col("t").alias("stop"))
    met = range_join(w, t, (F.col("start") > F.col("w_start")) & (F.col("start") < F.col("w_stop")), cell)
    met = met.select("event_id", (F.col("start") - F.col("w_start")).alias("at"), (F.col("w_stop") - F.col("w_start")).alias("length")).distinct()
    order = Window.partitionBy("event_id").orderBy("at")
    if shortest:
        near = met.withColumn("before", F.lag("at", 1, 0.0).over(order)).withColumn("after", F.coalesce(F.lead("at").over(order), "length"))
        met = near.filter((F.col("at") - F.col("before") >= shortest) & (F.col("after") - F.col("at") >= shortest))
    ends = met.select("event_id", "at").unionByName(events.select("event_id", (F.col("stop") - F.col("start")).alias("at")))
    parts = ends.select("event_id", (F.row_number().over(order) - 1).alias("piece"), F.lag("at", 1, 0.0).over(order).alias("offset"), "at")
    whole = events.select(*(c for c in events.columns if c not in ("piece", "offset", "duration", "stop")))
    cut = whole.join(parts, "event_id").withColumn("start", F.col("start") + F.col("offset")).withColumn("duration", F.col("at") - F.col("offset"))
    return cut.withColumn("stop", F.col("start") + F.col("duration")).drop("at")


def order_in_timeline() -> Window:
    """The order of validated events: start ascending, longer first, id last."""
    return Window.partitionBy("timeline").orderBy("start", F.desc("duration"), "event_id")


def best_offsets(songs: DataFrame, samples: DataFrame, bins: int, tolerance: float) -> DataFrame:
    """(song, sample, score, offset): how many tokens of a sample (sample, token, freq, t) lie at one offset in time from tokens of a song
    (song, freq, t), at the best of the offsets between two tokens whose frequencies are at most `bins` apart; the least of
    equally good offsets. Offsets closer than `tolerance` are one. Times count in steps of 2^-22 s, which leaves seconds since 1970 as they are.

    Samples are a stated query set. Whole songs and whole samples meet in cells of some thousand tokens a side; only tokens are sent
    there, and pairs of tokens are made and counted in a task, some at once."""
    songs = songs.filter("song is not null and t is not null").select("song", F.col("freq").cast("double").alias("freq"), F.col("t").cast("double").alias("t"))
    samples = samples.filter("sample is not null and t is not null").select("sample", "token", F.col("freq").cast("double").alias("freq"), F.col("t").cast("double").alias("t"))

    def blocks(rows: DataFrame, key: str, tokens: int) -> int:
        n, keys = rows.agg(F.count("*"), F.count_distinct(key)).first()
        return max(1, -(-n // tokens), -(-keys // 1024))

    p, q = blocks(songs, "song", 8192), blocks(samples, "sample", 16_384)
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = min(p * q, 4096)
    left = songs.select(mine("song", p).alias("_a"), every(q).alias("_b"), "*").repartition(parts, "_a", "_b")
    right = samples.select(every(p).alias("_a"), mine("sample", q).alias("_b"), "*").repartition(parts, "_a", "_b")
    kinds = [to_arrow_type(d.schema[c].dataType) for d, c in ((songs, "song"), (samples, "sample"))]
    schema = pa.schema([("song", kinds[0]), ("sample", kinds[1]), ("score", pa.int64()), ("offset", pa.float64())])

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return schema.empty_table()
        coded = lambda t, c: t.column(c).combine_chunks().dictionary_encode()
        number = lambda c: c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        side = lambda t, c: offsets.Side(number(c), t.column("t").to_numpy(), t.column("freq").to_numpy())
        song, sample = coded(a, "song"), coded(b, "sample")
        i, j, score, offset = offsets.best(side(a, song), side(b, sample), number(coded(b, "token")), bins, tolerance)
        return pa.Table.from_arrays([song.dictionary.take(pa.array(i)), sample.dictionary.take(pa.array(j)), pa.array(score, pa.int64()), pa.array(offset, pa.float64())], schema=schema)

    types = [d.schema[c].dataType.simpleString() for d, c in ((songs, "song"), (samples, "sample"))]
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(met, f"song {types[0]}, sample {types[1]}, score long, offset double")
