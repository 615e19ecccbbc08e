"""Numeric array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(x: Column, y: Column, by: str = "y") -> Column:
    """Dot product over the norms that `by` names: none, x, y or xy."""
    out = dot(x, y)
    if by in ("x", "xy"):
        out = out / norm(x)
    if by in ("y", "xy"):
        out = out / norm(y)
    return out


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))


def softmax(a: Column) -> Column:
    z = log_sum_exp(a)
    return F.transform(a, lambda x: F.exp(x - z))


def argmax(a: Column) -> Column:
    """Place of the greatest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def pad(a: Column, size: int) -> Column:
    """Cut or filled with zeros to `size` elements."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size)


def pool(rows: Column, how: str) -> Column:
    """An array of equally long arrays as one: mean, sum, max, first or last."""
    if how == "first":
        return F.element_at(rows, 1)
    if how == "last":
        return F.element_at(rows, -1)
    join = (lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))) if how == "max" else (lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    out = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.element_at(rows, 1), join)
    return F.transform(out, lambda x: x / F.size(rows)) if how == "mean" else out


def pool_layers(layers: Column, n: int, at: list[float] | None, how: str) -> Column:
    """Some of `n` layers (an array of equally long arrays) as one: mean or sum; or group_mean, an array of the means of the layers from each
    of them to before the next, the last one with the one before. `at` names layers by their share of the depth (0 to 1), none
    for all; equal ones count once, and a single one is itself."""
    picked = sorted({int(x * (n - 1)) for x in at}) if at is not None else list(range(n))
    if len(picked) == 1:
        return F.element_at(layers, picked[0] + 1)
    if how == "group_mean":
        edges = [*picked[:-1], picked[-1] + 1]
        return F.array(*(pool(F.slice(layers, a + 1, b - a), "mean") for a, b in zip(edges, edges[1:], strict=False)))
    return pool(F.array(*(F.element_at(layers, i + 1) for i in picked)), how)


def binary_round(value: Column, places: int) -> Column:
    """Rounded as SQL engines of C do: the double is scaled, and the scaled one is rounded, halves away from zero. `F.round` takes the shortest
    decimal text instead, so that halves that no double holds (0.15) go another way."""
    scale = F.lit(10.0**places)
    return F.round(value * scale, 0) / scale
