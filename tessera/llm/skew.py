"""A join for keys of very different frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def join_frequent(rows: DataFrame, info: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of `rows` with `info`, both tables; `info` has one row for each key and the number of the key's rows in `count`.

    Keys that have at least a SHARE-th of all counted rows are SHARE at most: they are broadcast, and their rows do not enter the
    shuffle that joins the others, so that no task gets all rows of one key."""
    total = info.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * SHARE >= total
    hot = info.filter(often)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(info.filter(~often), keys))
