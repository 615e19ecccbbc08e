"""Incremental processing with Structured Streaming. Every flow runs on what is there (availableNow) with its checkpoint in a
folder that the caller names, so a later call goes on where the last one ended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import delete, folders


def source(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def poll(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Append all rows that are new since the last poll to a Parquet folder, each once."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sweep(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], dead: str | None = None) -> list[str]:
    """Hand each micro-batch to `work`. A batch that fails does not stop the others: it is named in the result, its rows go
    to the folder `dead` (beside the checkpoint), and the next sweep hands them to `work` again under their old number."""
    dead = dead or f"{checkpoint.rstrip('/')}-failed"
    spark, failed = stream.sparkSession, []

    def tried(batch: DataFrame, number: int) -> bool:
        try:
            work(batch, number)
        except Exception as e:  # noqa: BLE001  the failure is reported and its rows are kept, the sweep goes on
            failed.append(f"{number}: {e}")
            return False
        return True

    for name in folders(spark, dead):
        if tried(spark.read.schema(stream.schema).parquet(f"{dead}/{name}"), int(name)):
            delete(spark, f"{dead}/{name}")

    def one(batch: DataFrame, number: int) -> None:
        if not tried(batch, number):
            batch.write.mode("overwrite").parquet(f"{dead}/{number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return failed


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a batch: keys that the sink does not hold yet."""
    return todo.join(done.select(key), key, "left_anti")


def ndjson_records(chunks: DataFrame, schema: str, key: str = "stream", seq: str = "seq", text: str = "value") -> DataFrame:
    """(key, fields of `schema`): records of newline-delimited JSON that arrives in chunks, cut anywhere, in the order of `seq` for
    each key. A line may run over any number of chunks; lines that do not parse are left out, the last one counts as it is.

    The number of line ends before a chunk numbers its lines, so the parts of one line meet by (key, number)."""
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    numbered = chunks.select(key, seq, parts.alias("parts"), F.coalesce(F.sum(F.size(parts) - 1).over(before), F.lit(0)).alias("base"))
    pieces = numbered.select(key, seq, "base", F.posexplode("parts").alias("k", "piece")).filter("piece <> ''")
    lines = pieces.groupBy(key, (F.col("base") + F.col("k")).alias("line")).agg(F.sort_array(F.collect_list(F.struct(seq, "piece"))).alias("all"))
    record = F.from_json(F.array_join(F.transform("all", lambda x: x["piece"]), ""), schema, {"mode": "PERMISSIVE"})
    return lines.select(key, record.alias("r")).filter(F.col("r").isNotNull() & (F.to_json("r") != "{}")).select(key, "r.*")


def event_windows(stream: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of values in event-time windows, with a watermark. `ts` is cast, as a watermark needs a zoned time."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def smooth(stream: DataFrame, keep: float = 0.8) -> DataFrame:
    """Exponential smoothing for each user over the micro-batches: the state is the last value. Emits a row a user and batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, n = state.get if state.exists else (0.0, 0)
        # a user has few rows a batch: arrays cost a fraction of what a frame of its own does
        parts = [[f[c].to_numpy() for c in ("event_id", "ts", "value")] for f in batches]
        ids, times, values = (np.concatenate(c) for c in zip(*parts, strict=True))
        for v in values[np.lexsort((ids, times))].tolist():
            s = s * keep + v * (1 - keep)
        n += len(values)
        state.update((s, n))
        yield pd.DataFrame({"user_id": [key[0]], "s": [s], "n": [n]})

    return stream.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(fold, "user_id long, s double, n long", "s double, n long", "update", "NoTimeout")


def read_through(requests: DataFrame, cache: DataFrame, key: str, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows): known keys come from the cache, the others from `fetch`, once each."""
    missing = requests.select(key).distinct().join(cache.select(key), key, "left_anti")
    fresh = fetch(missing)
    return requests.join(cache.unionByName(fresh), key, "left"), fresh
