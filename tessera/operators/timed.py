"""Sampled arrays on a time axis, event aggregation, baselines, moods, splits at sentence boundaries and batch-merged scaling."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.order import smoothed

#: Fixed value: relative precision of single floats.
EPS32 = 1.1920928955078125e-07


def overlap_slice(samples: Column, array_start: Column, frequency: float, start: Column, duration: Column) -> Column:
    """struct(start, duration, samples): what a window covers of an array sampled at `frequency` from `array_start` on, null
    where they do not meet. Places are rounded to samples, halves to even; at least one sample, pulled back at the right
    edge."""
    n = F.size(samples)
    length = n / F.lit(float(frequency))
    since, until = F.greatest(start, array_start), F.least(start + duration, array_start + length)
    apart = (until < since) | ((until == since) & (length > 0) & (duration > 0)) | (n == 0)
    place = lambda seconds: F.bround(seconds * F.lit(float(frequency)), 0).cast("int")
    count = F.greatest(place(until - since), F.lit(1))
    first = F.least(place(since - array_start), n - count)
    part = F.struct((first / F.lit(float(frequency)) + array_start).alias("start"), (count / F.lit(float(frequency))).alias("duration"), F.slice(samples, first + 1, count).alias("samples"))
    return F.when(~apart, part)


def combine_events(rows: DataFrame, how: str, key: str = "segment", order: tuple[str, ...] = ("start", "event_id"), data: str = "data", trigger: str = "is_trigger") -> DataFrame:
    """(key, data): the arrays of a segment's events, in order, as one.

    sum, average, first, last, middle (of n, the one at n // 2), trigger (the segment's own event; null where it is not among
    them), single (an error if there are more), cat (one after another), stack (an array of arrays)."""
    one = F.struct(*order, data)
    taken = F.when(F.col(trigger), one) if how == "trigger" else one
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(taken)).alias("all")).select(key, F.transform("all", lambda x: x[data]).alias("all"))
    n, every = F.size("all"), F.col("all")
    if how == "trigger":
        out = F.get(every, 0)
    elif how == "first":
        out = F.element_at(every, 1)
    elif how == "single":
        out = F.when(n > 1, F.raise_error(F.format_string("%d events in a segment that should have one", n)).cast(rows.schema[data].dataType)).otherwise(F.element_at(every, 1))
    elif how == "last":
        out = F.element_at(every, -1)
    elif how == "middle":
        out = F.element_at(every, F.floor(n / 2).cast("int") + 1)
    elif how == "cat":
        out = F.flatten(every)
    elif how == "stack":
        out = every
    elif how in ("sum", "average"):
        out = A.pool(every, "mean" if how == "average" else "sum")
    else:
        raise ValueError(f"no such way to combine events: {how}")
    return g.select(key, out.alias(data))


def combine_features(features: list[Column], how: str) -> Column:
    """Equally long features of one event as one: cat, stack, sum or average."""
    every = F.array(*features)
    if how == "cat":
        return F.flatten(every)
    if how == "stack":
        return every
    if how in ("sum", "average"):
        return A.pool(every, "mean" if how == "average" else "sum")
    raise ValueError(f"no such way to combine features: {how}")


def baseline_corrected(rows: DataFrame, since: float, until: float, clamp: float | None = None, key: str = "timeline", time: str = "start", value: str = "value") -> DataFrame:
    """`rows` with `corrected`: the value less the mean of the key's values from `since` to before `until` seconds around it, if
    there are any, then clamped to [-clamp, clamp]."""
    micros = F.round(F.col(time) * 1_000_000).cast("long")
    span = Window.partitionBy(key).orderBy("_us").rangeBetween(round(since * 1_000_000), round(until * 1_000_000) - 1)
    out = rows.withColumn("_us", micros).withColumn("corrected", F.col(value) - F.coalesce(F.avg(value).over(span), F.lit(0.0))).drop("_us")
    return out if clamp is None else out.withColumn("corrected", F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.col("corrected"))))


#: What each emotion makes of face shapes: a weight for each, what is added, and the levels that shapes must exceed. They
#: stand in the order in which emotions are compared.
EMOTIONS = {
    "Smile": ({"smile": 1.0}, 0.0, {}),
    "Laugh": ({"smile": 0.6, "jaw_open": 0.8}, 0.0, {"smile": 0.4, "jaw_open": 0.15}),
    "Sad": ({"brow_inner": 0.5, "frown": 0.5}, 0.0, {}),
    "Angry": ({"brow_down": 4.0, "squint": 0.5, "nose": 0.2}, -0.12, {"brow_down": 0.03}),
    "Surprised": ({"jaw_open": 0.8, "eye_wide": 0.2}, 0.0, {}),
    "Fear": ({"brow_inner": 0.4, "brow_outer": 0.3, "eye_wide": 0.3, "stretch": 0.1}, -0.15, {}),
    "Sleepy": ({"blink": 2.5}, -1.5, {}),
}
#: A laugh ends at 1 and, above 0.5, leaves a smile of 0.2; an open jaw takes 1.2 of its share from sadness.
LAUGH_MOST, LAUGH_HIDES, SMILE_LEFT, JAW_ON_SADNESS = 1.0, 0.5, 0.2, 1.2
#: The level that a dominant emotion exceeds; the level from which an emotion counts for the mood, and how much.
NEUTRAL = 0.15
MOOD = {"Smile": (0.05, 2.0), "Laugh": (0.05, 2.5), "Surprised": (0.15, 0.5), "Angry": (0.05, -2.0), "Sad": (0.05, -1.5), "Fear": (0.15, -1.2)}


def emotion_targets(shape: dict[str, Column], base: dict[str, float] | None = None) -> list[Column]:
    """What a frame's face shapes (0 to 1; pairs of sides already averaged) say of each emotion. `base` holds resting levels of
    brow_inner, brow_down, brow_inner_down and nose, above which those count."""
    raised = {n: F.greatest(F.lit(0.0), shape[n] - F.lit(float((base or {}).get(n, 0.0)))) for n in ("brow_inner", "brow_down", "brow_inner_down", "nose")}
    face = {**shape, **raised, "brow_down": F.greatest(raised["brow_down"], raised["brow_inner_down"])}
    out = {}
    for name, (weights, added, gates) in EMOTIONS.items():
        level = F.lit(added)
        for n, weight in weights.items():
            level = level + face[n] * weight
        for n, least in gates.items():
            level = F.when(face[n] > least, level).otherwise(0.0)
        out[name] = F.greatest(F.lit(0.0), level)
    out["Laugh"] = F.least(F.lit(LAUGH_MOST), out["Laugh"])
    out["Smile"] = F.when(out["Laugh"] > LAUGH_HIDES, SMILE_LEFT).otherwise(out["Smile"])
    out["Sad"] = F.greatest(F.lit(0.0), out["Sad"] * (1 - face["jaw_open"] * JAW_ON_SADNESS))
    return list(out.values())


def moods(frames: DataFrame, key: str, order: list[str], shape: dict[str, Column], base: dict[str, float] | None = None, keep: float = 0.8) -> DataFrame:
    """(key, levels, dominant, mood) after the last frame of each key: emotions smoothed over its frames, the strongest one above
    NEUTRAL (sadness aside), and a mood from 0 (bad) to 1 (good); 0.5 where none is dominant."""
    rows = frames.select(key, *order, F.array(*emotion_targets(shape, base)).alias("target"))
    out = smoothed(rows, key, order, "target", keep)
    level = {name: F.element_at("levels", i) for i, name in enumerate(EMOTIONS, 1)}
    seen = [name for name in EMOTIONS if name != "Sad"]
    top = F.greatest(*(level[name] for name in seen))
    dominant = F
    for name in seen:
        dominant = dominant.when((top > NEUTRAL) & (level[name] == top), name)
    dominant = dominant.otherwise("Neutral")
    balance = F.lit(0.0)
    for name, (least, weight) in MOOD.items():
        balance = balance + F.when(level[name] > least, level[name] * weight).otherwise(0.0)
    mood = F.when(top > NEUTRAL, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (balance + 1) / 2))).otherwise(0.5)
    return out.select(key, "levels", dominant.alias("dominant"), mood.alias("mood"))


def sentence_splits(events: DataFrame, k: int) -> DataFrame:
    """`events` (timeline, type, start, duration, text) with `split`: words go to `k` contiguous splits that end where sentences end.

    The splits are shared out over the timelines in their order, at least one each; all roundings go to even. A timeline's splits are
    named by the hash of its sentences' joined texts. Words behind the last boundary, and other events, have an empty split. A
    timeline with fewer sentences than splits is an error."""
    lines = events.select("timeline").distinct()
    n = lines.count()
    if k > n:  # at most k timelines then
        more = lambda g: F.bround((k - n) * g / F.lit(float(n)), 0)
        ordinal = F.row_number().over(Window.orderBy("timeline"))
        lines = lines.select("timeline", (1 + more(ordinal) - more(ordinal - 1)).cast("int").alias("parts"))
    else:
        lines = lines.select("timeline", F.lit(1).alias("parts"))
    s = events.filter("type = 'Sentence'").groupBy("timeline").agg(F.array_sort(F.collect_list(F.struct("start", "duration", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
    s = lines.join(s, "timeline", "left").withColumn("m", F.coalesce(F.size("s"), F.lit(0)))
    enough = F.when(F.col("m") < F.col("parts"), F.raise_error(F.format_string("%d sentences for %d splits", "m", "parts")).cast("int")).otherwise(F.col("parts"))
    place = lambda i: F.bround((F.col("m") - 1) * i / F.col("parts"), 0).cast("int") + 1
    stops = F.transform(F.sequence(F.lit(1), enough), lambda i: F.element_at("s", place(i))["start"] + F.element_at("s", place(i))["duration"])
    name = F.substring(F.sha2(F.array_join(F.transform("s", lambda x: x["text"]), " "), 256), 1, 8)
    s = s.select("timeline", "parts", stops.alias("stops"), name.alias("name"))
    first = F.array_position(F.transform("stops", lambda x: F.col("start") < x), True)
    split = F.when((F.col("type") == "Word") & (first > 0), F.format_string("%s-ksplit%d/%d", "name", first, "parts")).otherwise("")
    return events.join(s, "timeline").select(*events.columns, split.alias("split"))


def merged_scaler(batches: DataFrame) -> DataFrame:
    """(d, mean, var, scale): mean and variance of each dimension from (batch, d, x), merged batch by batch in their order.

    A batch counts by its own sample variance, weighted by its share of the rows so far, so the result depends on where
    batches end. A variance that single floats cannot tell from none, judged by the rows before the last batch, gives
    scale 1. Batches are reduced to count, mean and variance before they are merged; only those are folded."""
    one = batches.groupBy("d", "batch").agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    every = one.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("batch", "n", "mean", "var"))).alias("b"))
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("seen", "mean", "var", "before")))

    def merge(s: Column, b: Column) -> Column:
        total = s["seen"] + b["n"]
        old, new = s["seen"] / total, b["n"] / total
        gap = s["mean"] - b["mean"]
        return F.struct(total.alias("seen"), (old * s["mean"] + new * b["mean"]).alias("mean"), (old * s["var"] + new * b["var"] + old * new * gap * gap).alias("var"), s["seen"].alias("before"))

    m = every.select("d", F.aggregate("b", start, merge).alias("m")).select("d", "m.*")
    flat = F.col("var") <= F.col("before") * EPS32 * F.col("var") + F.pow(F.col("before") * F.col("mean") * EPS32, 2)
    return m.select("d", "mean", "var", F.when(flat, 1.0).otherwise(F.sqrt("var")).alias("scale"))


def typed_classes(truth: Column, typed: Column) -> Column:
    """A letter for each typed character: m(atch), s(ubstitution) or a(ddition), by the edit script from the truth."""

    @F.pandas_udf("string")
    def classes(t: pd.Series, g: pd.Series) -> pd.Series:
        letter = {"equal": "m", "replace": "s", "insert": "a", "delete": ""}
        return pd.Series(["".join(letter[op] * (l - k) for op, _, _, k, l in difflib.SequenceMatcher(None, x or "", y or "").get_opcodes()) for x, y in zip(t, g, strict=True)])

    return classes(truth, typed)


def error_rates_by_class(rows: DataFrame, key: str) -> DataFrame:
    """(key, right_rate, wrong_rate) from (key, truth, typed, predicted): how often a prediction differs from what was typed, where
    that was right and where it was a mistake; null without such characters. Rows whose prediction has another length are left
    out."""
    r = rows.filter(F.length("typed") == F.length("predicted")).select(key, "typed", "predicted", typed_classes(F.col("truth"), F.col("typed")).alias("kind"))
    at = F.explode(F.when(F.length("typed") > 0, F.sequence(F.lit(1), F.length("typed"))).otherwise(F.array().cast("array<int>")))
    c = r.select(key, "typed", "predicted", "kind", at.alias("i"))
    c = c.select(key, (F.substring("typed", F.col("i"), F.lit(1)) != F.substring("predicted", F.col("i"), F.lit(1))).cast("double").alias("wrong"), (F.substring("kind", F.col("i"), F.lit(1)) == "m").alias("right"))
    return c.groupBy(key).agg(F.avg(F.when(F.col("right"), F.col("wrong"))).alias("right_rate"), F.avg(F.when(~F.col("right"), F.col("wrong"))).alias("wrong_rate"))


def concat_aligned(left: DataFrame, right: DataFrame, aligned: DataFrame, key: str) -> DataFrame:
    """Rows of two ordered lists (key, ord, ...) side by side where `aligned` (key, a, b) pairs them; of columns with one name,
    the left one stays."""
    more = [c for c in right.columns if c not in left.columns]
    pairs = aligned.join(left.withColumnRenamed("ord", "a"), [key, "a"])
    pairs = pairs.join(right.select(key, F.col("ord").alias("b"), *more), [key, "b"])
    return pairs.select(key, F.col("a").alias("ord"), *(c for c in left.columns if c not in (key, "ord")), *more)
