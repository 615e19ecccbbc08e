"""Events of a window as levels of its samples; where events overlap the greatest level stays.

Input rows: w_id, w_start, w_duration, start, duration and, for class modes, code. An event counts if its centre lies in the
window. Sample numbers are cut off towards zero. The output holds the samples with a level; a missing one is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modes that are declared without a meaning of their own: they give no levels.
EMPTY = ("super_smooth_constant_start", "super_smooth_constant_end", "middle_presence")
LISTED = ("start_DETR", "end_DETR", "center_DETR", "duration_DETR", "class_DETR", "multiclass_DETR")


def cut(c: Column) -> Column:
    """Towards zero, as a whole number."""
    return c.cast("long")


def gaussian(k: Column, centre: Column, sigma: Column) -> Column:
    return F.exp(F.lit(-0.5) * F.pow(k - centre, F.lit(2.0)) / F.pow(sigma, F.lit(2.0)))


def rasterise(rows: DataFrame, mode: str, frequency: float, smooth_window: float = 1.0, kind: str = "gaussian", sigma: float = 3.0, longest: float = 1.0) -> DataFrame:
    """(w_id, k, level). `smooth_window` in seconds for smooth, `sigma` in samples for the sharp kernels, `longest` event in samples
    for the relative durations."""
    n = cut(F.col("w_duration") * frequency)
    if mode in EMPTY:
        return rows.select("w_id", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("level")).limit(0)
    middle_time = F.col("start") + F.col("duration") / 2
    rows = rows.filter((middle_time >= F.col("w_start")) & (middle_time < F.col("w_start") + F.col("w_duration")))
    first = cut((F.col("start") - F.col("w_start")) * frequency)
    last = cut((F.col("start") + F.col("duration") - F.col("w_start")) * frequency)
    r = rows.withColumn("n", n).withColumn("i", first).withColumn("j", last)
    r = r.withColumn("c", cut((F.col("i") + F.col("j")) / 2))
    i, j, c, n = F.col("i"), F.col("j"), F.col("c"), F.col("n")
    size = (j - i).cast("double")
    one = F.lit(1.0)
    points = {"start": (i, one), "middle": (c, one), "super_smooth_just_one": (c, one), "duration_middle": (c, F.col("duration") / F.col("w_duration")), "duration_label": (c, size / longest), "raw_duration": (c, size)}
    if mode in points:
        at, level = points[mode]
        return _highest(r.select("w_id", "n", at.alias("k"), level.alias("level")))
    clipped = (F.greatest(i, F.lit(0)), F.least(j, n))
    whole = F.floor((i + j) / 2)
    half = F.lit(int(smooth_window * frequency / 2)).cast("long")
    reach = F.lit(int(3 * sigma)).cast("long")
    if mode in ("flat_confidence", "class_label_full"):
        level = one if mode == "flat_confidence" else F.col("code").cast("double")
        return _spread(r, *clipped, lambda k: level)
    if mode == "duration_label_full":
        return _spread(r.filter((i >= 0) & (i < j) & (j <= n)), i, j, lambda k: size / longest)
    if mode == "smooth":
        a, b = F.greatest(F.lit(0), c - half), F.least(n, c + half)
        mid = F.floor((b - a) / 2)
        if kind == "gaussian":
            return _spread(r, a, b, lambda k: gaussian(k - a, mid, (half / 2).cast("double")))
        return _spread(r, a, b, lambda k: 1 - F.abs(k - a - mid) / (mid + 1))
    if mode in ("super_smooth", "super_smooth_constant"):
        return _spread(r, F.greatest(F.lit(0), c - reach), F.least(n, c + reach), lambda k: gaussian(k, c, F.lit(float(sigma))))
    raise ValueError(f"unknown mode {mode}; modes {LISTED} give lists, see listed()")


def reaction(rows: DataFrame, frequency: float, sigma_seconds: float, offset: float = 0.0) -> DataFrame:
    """A kernel of sum 1 around each reaction time (column rt, half a second less, at least 0)."""
    s = sigma_seconds * frequency
    half = F.lit(int(3 * s)).cast("long")
    r = rows.withColumn("n", cut(F.col("w_duration") * frequency)).withColumn("c", cut((F.greatest(F.col("rt"), F.lit(0.5)) - 0.5 + offset) * frequency)).filter("c >= 0 and c < n")
    a, b, c = F.greatest(F.lit(0), F.col("c") - half), F.least(F.col("n"), F.col("c") + half), F.col("c")
    total = F.aggregate(F.sequence(a, b - 1), F.lit(0.0), lambda x, k: x + gaussian(k, c, F.lit(s)))
    return _spread(r.filter(b > a), a, b, lambda k: gaussian(k, c, F.lit(s)) / total)


def listed(rows: DataFrame, mode: str, most: int) -> DataFrame:
    """(w_id, values): relative starts, ends, centres, durations or codes of a window's events in their order, cut or filled with
    zeros to `most`."""
    rel = lambda c: (c - F.col("w_start")) / F.col("w_duration")
    value = {
        "start_DETR": rel(F.col("start")),
        "end_DETR": rel(F.col("start") + F.col("duration")),
        "center_DETR": rel(F.col("start") + F.col("duration") / 2),
        "duration_DETR": F.col("duration") / F.col("w_duration"),
        "class_DETR": F.lit(1.0),
        "multiclass_DETR": F.col("code").cast("double") if "code" in rows.columns else F.lit(0.0),
    }[mode]
    held = F.transform(F.array_sort(F.collect_list(F.struct("start", "duration", value.alias("v")))), lambda x: x.v)
    return rows.groupBy("w_id").agg(F.slice(F.concat(held, F.array_repeat(F.lit(0.0), most)), 1, most).alias("values"))


def _highest(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("k") >= 0) & (F.col("k") < F.col("n"))).groupBy("w_id", "k").agg(F.max("level").alias("level"))


def _spread(rows: DataFrame, a: Column, b: Column, level) -> DataFrame:
    """Levels of the samples from a to b - 1."""
    each = F.explode(F.when(b > a, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda k: F.struct(k.alias("k"), level(k).alias("level")))).otherwise(F.array().cast("array<struct<k:bigint,level:double>>")))
    return _highest(rows.select("w_id", "n", each.alias("x")).select("w_id", "n", "x.k", "x.level"))
