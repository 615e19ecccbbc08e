"""The corpus pipeline: quality, near-duplicates, repeated passages, decontamination, tokens.

Each stage takes all that the one before kept, and its decisions take effect: documents of low quality go, one document of
each near-duplicate group stays, passages that repeat across documents are cut out of the texts (n_chars follows), documents
that hold a benchmark passage go, and what is left is encoded and decoded.

Cases. Each row is a document, whatever its id: rows that share an id, or have none, stay or go by their own texts; only rows that
repeat both id and text become one (in the near-duplicate and suffix-array stages). Null texts count as empty ones; an empty text is
scored, is no copy of anything, holds no passage and has no tokens. Texts of any length are used whole. Empty tables give empty ones
at every stage, also without labels (every score is 0.5 then) or benchmark items. All stages but the last return doc_id, text, lang,
source and n_chars; other columns of the documents are not read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, dedup, neardup, quality
from tessera.llm.catalog import held_out
from tessera.session import table

COLUMNS = ("text", "lang", "source", "n_chars")
#: Several stages join, which SQL alone cannot express: tests hold them against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train_quality(docs, labels, allowed=~held_out("_id", 5, 0))
    return quality.score_quality(docs, model, keep=COLUMNS).filter("score >= 0.3").drop("score")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group; of rows that repeat an id and a text, one."""
    kept = neardup.near_duplicates(docs).filter("kept").select("doc_id")
    n, ids, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == ids == distinct:
        return docs.join(kept, "doc_id", "left_semi").select("doc_id", *COLUMNS)
    kept = kept.distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").dropDuplicates(["doc_id", "text"]).select("doc_id", *COLUMNS)


def keyed(docs: DataFrame, merge: bool) -> tuple[DataFrame, str]:
    """The documents with a column that names each row: doc_id where it is neither null nor repeated, else a number.
    With `merge`, rows that repeat both id and text become one before they are numbered."""
    n, ids, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == ids == distinct:
        return docs, "doc_id"
    rows = docs.dropDuplicates(["doc_id", "text"]) if merge else docs
    return table(rows.withColumn("row_key", F.monotonically_increasing_id())), "row_key"


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start anywhere else, too. Rows that repeat both id and text become
    one; rows that only share an id, or have none, are documents of their own."""
    docs, key = keyed(docs, merge=True)
    left = dedup.suffix_array_dedup(docs, window=200, id_col=key, text=True).select(F.col(key).alias("_left"), F.col("kept_text").alias("text"))
    rest = docs.select(F.col(key).alias("_rest"), "doc_id", "lang", "source")
    joined = left.join(rest, F.col("_left") == F.col("_rest"))
    return joined.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item. Each row is judged by its own text, whatever its id."""
    docs, key = keyed(docs, merge=False)
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, id_col=key)
    bad = table(found.filter("n_hit > 0").select(F.col(key).alias("_bad")).distinct())
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti").select("doc_id", *COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text that they decode to."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("lang", "source"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir))
    return docs
