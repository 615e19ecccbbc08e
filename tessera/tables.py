"""Tables of a scale-factor folder, and the views that give them the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals: timeline = user, start in seconds (UTC), duration = value * 600 s."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("timeline"), F.col("event_type").alias("type"), start.alias("start"), (F.col("value") * 600).alias("duration"), (start + F.col("value") * 600).alias("stop"), "value", "props"
    )


#: The same view for the SQL that checks the queries.
INTERVALS_SQL = "ev AS (SELECT event_id, user_id AS timeline, event_type AS type, epoch_us(ts) / 1e6 AS start, value * 600 AS duration, epoch_us(ts) / 1e6 + value * 600 AS stop, value, props FROM events)"
