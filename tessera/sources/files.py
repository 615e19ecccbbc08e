"""File sources: scraped CSV with header aliases, JSON with a JSON-lines fallback, whole texts keyed by name, captions, and study
tables. Schemas are explicit; paths may be on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import caption_text, cite_slug


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """First non-empty, trimmed value of the columns of `names` that exist."""
    have = [c for c in names if c in df.columns]
    return F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in have), F.lit("")) if have else F.lit("")


def read_scraped_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A scraper's CSV (quoted line breaks, generic headers) as one column for each alias list."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return raw.select(*(first_filled(raw, names).alias(out) for out, names in aliases.items()))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files that hold an array, one object, or a line for each object. Malformed lines are left out."""
    whole = spark.read.text(path, wholetext=True)
    trimmed = F.ltrim("value")
    arrays = whole.filter(trimmed.startswith("[")).select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r"))
    lines = whole.filter(~trimmed.startswith("[")).select(F.from_json("value", f"struct<{schema}>").alias("one"), F.split("value", "\n").alias("l"))
    parsed = F.filter(F.transform("l", lambda x: F.from_json(F.nullif(F.trim(x), F.lit("")), f"struct<{schema}>", {"mode": "PERMISSIVE"})), lambda r: r.isNotNull() & (F.to_json(r) != "{}"))
    several = F.size(F.filter("l", lambda x: F.trim(x) != "")) > 1
    rows = lines.select(F.explode(F.when(several & (F.size(parsed) > 0), parsed).otherwise(F.array("one"))).alias("r"))
    return arrays.unionByName(rows).filter(F.to_json("r") != "{}").select("r.*")


def read_texts_by_slug(spark: SparkSession, glob: str) -> DataFrame:
    """(slug, text): whole files keyed by their base name."""
    df = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("n"), F.col("value").alias("text"))
    return df.select(cite_slug(F.regexp_replace("n", r"\.[^.]*$", "")).alias("slug"), "text")


def read_captions(spark: SparkSession, glob: str) -> DataFrame:
    """(name, said): spoken text of WebVTT or SRT files."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("name"), caption_text(F.col("value")).alias("said"))


def load_study(spark: SparkSession, events: DataFrame, cache: str, query: str | None = None, enhancers: tuple = ()) -> DataFrame:
    """Events of the timelines that a query over their summary selects, enhanced in order and cached as Parquet.

    The query prunes before anything else runs, so only its timelines are read."""
    if query:
        ids = events.groupBy("timeline").agg(F.count("*").alias("n_events"), F.min("start").alias("first")).filter(query).select("timeline")
        events = events.join(ids, "timeline", "left_semi")
    for f in enhancers:
        events = events.transform(f)
    events.write.mode("overwrite").parquet(cache)
    return spark.read.schema(events.schema).parquet(cache)
